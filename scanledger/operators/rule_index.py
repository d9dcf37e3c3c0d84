"""Secret scans with a table of rules: one pass of an anchor index over each text, regexes only on the lines they can match.

Every rule has an anchor, a literal that each of its matches holds. Tasks search whole texts for all anchors at once
(Aho-Corasick) and send the lines that hold one, with the rule; Spark then applies the rule's regex to that line. The
automaton is broadcast, so rules are dealt into blocks of BLOCK_BYTES of anchors, one pass over the texts each.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.functions.fingerprint import fingerprint
from scanledger.operators.detect import SECRET_RECOMMENDATION
from scanledger.session import ensure_checkpoint_dir

# the search travels to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of anchors in one automaton.
BLOCK_BYTES = 4 << 20


def automaton(anchors: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """Finds every anchor; its value lists the numbers of the rules that have it."""
    out, held = ahocorasick.Automaton(), {}
    for number, anchor in anchors:
        held.setdefault(anchor, []).append(number)
    for anchor, numbers in held.items():
        out.add_word(anchor, (len(anchor), numbers))
    out.make_automaton()
    return out


def anchored_lines(text: str, index: ahocorasick.Automaton) -> set[tuple[int, int, int, int]]:
    """(line number from 0, its begin, its end, rule number) of each line that holds a rule's anchor."""
    breaks, hits = None, set()
    for end, (length, numbers) in index.iter(text):
        if breaks is None:
            breaks = [-1, *(m.start() for m in re.finditer("\n", text)), len(text)]
        line = bisect_left(breaks, end - length + 1)  # the first break not before the anchor ends its line
        begin, stop = breaks[line - 1] + 1, breaks[line]
        if end < stop:  # an anchor across a break is in no line
            hits.update((line - 1, begin, stop, n) for n in numbers)
    return hits


_HIT = pa.schema([("id", pa.string()), ("line_no", pa.int64()), ("line", pa.string()), ("rule", pa.int64())])


def _searcher(told):
    def search(batches):
        index = automaton(told.value)
        for batch in batches:
            out = []
            for own, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for line, begin, end, rule in sorted(anchored_lines(text, index)) if text else ():
                    out.append((own, line + 1, text[begin:end], rule))
                    if len(out) >= 4096:
                        yield _rows(out)
                        out = []
            yield _rows(out)

    return search


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[]] * len(_HIT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HIT, strict=True)], schema=_HIT)


def scan_rules(df: DataFrame, id_col: str, text_col: str, rules: DataFrame, scanner: str = "gitleaks", path_prefix: str = "") -> DataFrame:
    """``detect.scan_text`` for a table of rules (rule_id, regex, anchor): a row for each line and rule that matches.

    Rules with a null or empty anchor are an error; so are two rules of one id.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    bad = rules.agg(F.count_if(F.coalesce("anchor", F.lit("")) == ""), F.count(F.lit(1)) - F.count_distinct("rule_id"), F.sum(F.octet_length("anchor"))).first()
    if bad[0] or bad[1]:
        raise ValueError(f"{bad[0]} rules without an anchor, {bad[1]} repeated or null rule ids")
    n_blocks = -(-(bad[2] or 0) // BLOCK_BYTES)
    numbered = rules.select("rule_id", "regex", "anchor", F.pmod(F.xxhash64("rule_id"), F.lit(max(1, n_blocks))).alias("block"))
    numbered = numbered.withColumn("rule", F.monotonically_increasing_id()).checkpoint()
    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    hits = None
    for block in range(n_blocks):
        own = [(r["rule"], r["anchor"]) for r in numbered.where(F.col("block") == block).select("rule", "anchor").collect()]  # BLOCK_BYTES, about
        told = spark.sparkContext.broadcast(own)
        found = texts.mapInArrow(_searcher(told), "id string, line_no bigint, line string, rule bigint")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], "id string, line_no bigint, line string, rule bigint")
    matched = hits.join(numbered.select("rule", "rule_id", "regex"), "rule").where(F.expr("line rlike regex"))
    out = matched.select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "line_no", "rule_id",
        F.lit(scanner).alias("scanner"), F.lit("CRITICAL").alias("severity"),
        F.concat(F.lit("Secret detected: "), F.col("rule_id")).alias("title"),
        F.concat(F.lit(path_prefix), F.col("id")).alias("file_path"),
        F.col("line_no").cast("int").alias("line"),
        F.lit(SECRET_RECOMMENDATION).alias("recommendation"),
    )
    return out.withColumn("fingerprint", fingerprint("scanner", "title", "file_path", "line", "rule_id"))
