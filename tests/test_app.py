import pathlib
import urllib.request

from heaplens.app import start
from heaplens.config import LogConfig, host_name

FIXTURES = pathlib.Path(__file__).parent / "fixtures"


def test_app(spark, tmp_path):
    log = tmp_path / "gc.log"
    log.write_text("")
    config = LogConfig(globs=[str(log)], listen="127.0.0.1:5999", host="localhost")
    assert (config.listen_host, config.port) == ("127.0.0.1", 5999) and LogConfig(globs="x").host == host_name()
    for k in range(2):  # from the end at first; what comes between runs is read by the next
        query, scrape = start(spark, config, f"file://{tmp_path}/state", f"file://{tmp_path}/checkpoint", availableNow=True)
        assert query.awaitTermination(120)
        if k == 0:
            log.write_text((FIXTURES / "serial.log").read_text())
    server = scrape.serve("127.0.0.1", 0)
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}").read().decode()
    try:
        whole, picked = get("/metrics"), get("/metrics?name[]=gc_log_lines_total")
    finally:
        server.shutdown()
    assert f'gc_log_lines_total{{host="localhost",path="{log}"}} 4.0' in picked and "gc_event" not in picked
    assert 'gc_exporter_version_info{host="localhost",version="1"} 1.0' in whole and "gc_startup_timestamp_seconds{" in whole and 'quantile="0.75"' in whole
    assert 'category="DefNew"' in whole and "# TYPE gc_event_duration_seconds summary" in whole
    assert scrape.text({"none"}) == ""
