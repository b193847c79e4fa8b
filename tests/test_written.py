"""Files that the queries write keep the order of lines when the writer's sorts spill."""

import glob
import re
import subprocess
import sys

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC").config("spark.shuffle.spill.numElementsForceSpillThreshold", "200").getOrCreate())
from heaplens.plans import everything
everything._written(spark, "/root/testdata/sf0.001")
"""


def test_order_of_lines_outlasts_a_spill(tmp_path):
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], check=True, timeout=300)
    files = glob.glob(f"{tmp_path}/**/*.txt", recursive=True)
    assert len(files) == 15
    for name in files:
        with open(name) as f:
            text = f.read()
        ids = [int(x) for x in re.findall(r"GC\((\d+)\)", text)]
        assert text.startswith("[0.010s]") and ids == sorted(ids)
