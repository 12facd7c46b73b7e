"""A console over a built index: `python -m lumengrist.cli FOLDER`, FOLDER holding documents.parquet.

/k WORD recommends keywords, /s TEXT or plain TEXT searches pages, /help and /quit.
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import SparkSession

from .operators import codec, recommend
from .plans import registry as R
from .sources import stores

log = logging.getLogger("lumengrist")
HELP = "/k WORD: recommend keywords\n/s TEXT or TEXT: search pages\n/help\n/quit"


def answer(spark: SparkSession, sf_dir: str, kind: int, text: str) -> str:
    """The JSON that a request of this kind gets."""
    q = spark.createDataFrame([(1, text)], "query_id long, text string")
    if kind == 0:
        d = R.dictionary(spark, sf_dir)
        rows = codec.words_json(recommend.recommend(q, d, R.char_index(spark, sf_dir), R.counts(spark, sf_dir), stores.max_frequency(d), sizes=R.frequencies(spark, sf_dir)))
    else:
        rows = codec.pages_json(R.answers(q, spark, sf_dir))
    row = rows.first()
    return row["json"] if row else "[]"


def main(sf_dir: str, lines=sys.stdin) -> None:
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("lumengrist").getOrCreate()
    for line in lines:
        c = codec.commands(spark.createDataFrame([(line.rstrip("\n"),)], "line string")).first()
        log.debug("%s", c)
        if c["action"] == "quit":
            break
        if c["action"] == "help":
            print(HELP)
        elif c["action"] == "unknown":
            print(f"unknown command: {line.strip()} (/help)")
        elif c["action"] == "send":
            print(answer(spark, sf_dir, c["type"], c["text"]))


if __name__ == "__main__":
    main(sys.argv[1])
