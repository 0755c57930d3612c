"""Export of all scores as one JSON document."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.scoring import payload
from ledgerweave.plans.scratch import removed

VERSION = "0.2"


def _brand_lines(scores: DataFrame) -> DataFrame:
    """(brand_name, value): each brand's name and issues as they stand in the document, with a comma in front."""
    kind = "map<string, map<string, struct<score: double, dollars: double, candidates: bigint, confidence: string>>>"
    issues = F.transform_values(F.from_json("payload", "map<string, string>"), lambda _, v: F.from_json(v, "map<string, struct<score: double, dollars: double, candidates: bigint, confidence: string>>"))
    text = F.to_json(issues.cast(kind), {"ignoreNullFields": "false"})
    name = F.regexp_extract(F.to_json(F.struct(F.col("brand_name").alias("b"))), r"(?s)^\{\"b\":(.*)\}$", 1)
    return payload(scores).select("brand_name", F.concat(F.lit(", "), name, F.lit(": "), text).alias("value"))


def export_scores(scores: DataFrame, path: str | Path) -> int:
    """Writes {meta, brands} to one file below any URI that Spark reaches; returns the number of brands.

    Executors write the brands in order as parts of text beside the target; at the end the parts' bytes are strung
    together in a draft, which is renamed into place. No row passes through the driver's memory.
    """
    spark, target = scores.sparkSession, str(path)
    target = target if ":" in target.split("/")[0] else f"file://{Path(target).absolute()}"
    parts, draft = f"{target}.parts", f"{target}.draft"
    lines = _brand_lines(scores)
    lines.orderBy("brand_name").select("value").write.mode("overwrite").text(parts)
    n = spark.read.text(parts).count()
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    at = lambda text: hadoop.fs.Path(text)
    files = at(target).getFileSystem(conf)
    meta = {"version": VERSION, "generated_at": datetime.now(UTC).isoformat(), "brand_count": n}
    out = files.create(at(draft), True)
    try:
        out.write(bytearray(f'{{"meta": {json.dumps(meta)}, "brands": {{'.encode()))
        written = sorted((f.getPath().toString(), f.getLen()) for f in files.globStatus(at(f"{parts}/part-*")))
        for k, part in enumerate(p for p, size in written if size):
            read = files.open(at(part))
            if not k:
                read.skip(len(", "))  # in front of the first brand
            hadoop.io.IOUtils.copyBytes(read, out, conf, False)
            read.close()
        out.write(bytearray(b"}}"))
    finally:
        out.close()
    files.delete(at(target), False)
    files.rename(at(draft), at(target))
    removed(spark, parts)
    return n
