"""Chunks of the token encoder get numbers once, and joined chunks are told apart in bytes."""

from heaplens.llm.token_files import ChunkEncoder, Numbers


def test_numbers_tell_what_is_new():
    known = Numbers()
    assert known.of(["b", "a", "b"]).tolist() == [0, 1, 0] and known.fresh() == ["b", "a"] and known.fresh() == []
    assert known.of(["a", "c", "d"]).tolist() == [1, 2, 3] and known.fresh() == ["c", "d"]


def test_joined_chunks():
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        source = f.read()
    texts = ["größe 東京 naïve word, word. ünï! a  b  c\n d", "", None, " lead and trail ", "x y z  w 😀😀 é", "word, größe, größe größe."]
    plain, encoder = Tokenizer.from_str(source), ChunkEncoder(source, 2)
    for some in (texts[:3], texts[3:], texts):
        ids, sizes = encoder.encode(some)
        wanted = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in some]
        assert sizes.tolist() == [len(x) for x in wanted] and ids.tolist() == [i for x in wanted for i in x]
