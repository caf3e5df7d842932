"""One JSON line: median seconds of some queries and of the plain plan of each, at $BENCH_SF_DIR on local[$BENCH_CPUS].

A plain plan is what one writes first: joins by their inequalities, one window a key, a row a position. Both must give
the same number of rows.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.window import Window  # noqa: E402

from strandframe.plans import registry  # noqa: E402
from strandframe.session import session  # noqa: E402


def self_join(spark, d):
    a = registry.shipping(spark, d)
    b = a.select("l_suppkey", F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    both = a.join(b, "l_suppkey").filter((F.col("start") < F.col("e2")) & (F.col("end") > F.col("s2")) & (F.struct("l_orderkey", "l_linenumber") < F.struct("ok", "ln")))
    return both.groupBy("l_suppkey").agg(F.count("*").alias("pairs"), F.sum(F.least("end", "e2") - F.greatest("start", "s2")).alias("days"))


def one_window(spark, d):
    order = Window.partitionBy("l_suppkey").orderBy("start", "end", "l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    return registry.shipping(spark, d).select("l_orderkey", "l_linenumber", F.max("end").over(order).alias("max_end"))


def positions(spark, d, width, letters):
    rows = registry.docs(spark, d).filter("seq != ''").withColumn("seq", F.regexp_replace(F.translate("seq", "U", "T"), letters, "A")).filter(F.length("seq") >= width)
    return rows.select("doc_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - width)).alias("pos")).withColumn("window", F.substring(F.col("seq"), F.col("pos") + 1, F.lit(width)))


def postings(spark, d):
    return positions(spark, d, 6, "^$").groupBy(F.col("window").alias("kmer")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def mismatches(spark, d):
    rows = positions(spark, d, len(registry.LONG), "[^ACGT]")
    wrong = sum((F.substring("window", i + 1, 1) != c).cast("int") for i, c in enumerate(registry.LONG))
    return rows.select("doc_id", "pos", wrong.alias("mismatches")).filter("mismatches <= 2")


PLAIN = {"interval_self_join": self_join, "prefix_max_end": one_window, "kmer_postings": postings, "approx_locate": mismatches}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name, plain in PLAIN.items():
        out[name] = {}
        for kind, run in (("own", registry.QUERIES[name]), ("plain", plain)):
            rows, seconds = run(spark, sf_dir).count(), []
            for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
                began = time.time()
                run(spark, sf_dir).write.format("noop").mode("overwrite").save()
                seconds.append(time.time() - began)
            out[name][kind] = {"rows": rows, "seconds": round(statistics.median(seconds), 2)}
        print(name, out[name], file=sys.stderr, flush=True)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
