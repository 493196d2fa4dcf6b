"""Times extraction and derivation over synthesised modules: files a second, by number of files. Numbers as arguments."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

from tessera.functions import python_source
from tessera.operators import graph, imports
from tessera.project import Project

TEXT = "import os\nfrom app.m{0} import f{0}\n\n\nclass C:\n    def a(self, q):\n        self.x = q\n        return q\n\n    def b(self):\n        return self.x\n\n\ndef f(v, w):\n    # TODO\n" + "    if v > 1 and w:\n        v = v + w * 2\n" * 12 + "    return v\n"


def main() -> None:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    began = time.time()
    for k in range(200):
        python_source.analyse(TEXT.format(k))
    one = (time.time() - began) / 200
    out = {"one file, one thread, ms": round(1000 * one, 2), "lines a file": TEXT.count("\n")}
    for n in [int(x) for x in sys.argv[1:]] or [1_000, 10_000]:
        files = spark.range(n).select(F.concat(F.lit("app/m"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.replace(F.lit(TEXT), F.lit("{0}"), F.expr("id div 2").cast("string")).alias("content"))
        began = time.time()
        p = Project(spark, files)
        p.extract.all.count()
        mid = time.time()
        imports.coupling(p.modules, p.edges).count()
        graph.strong_components(p.edges).count()
        out[str(n)] = {"extraction s": round(mid - began, 2), "files a second": round(n / (mid - began)), "derivation s": round(time.time() - mid, 2)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
