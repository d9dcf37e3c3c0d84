"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character, longest first; dynamic programming
carries the best score and its number of pieces from each position to the next. Rules of the unigram tokenizer: the
larger sum of scores wins; of equal sums the piece that begins first; a character that is no piece itself can also
be taken as unknown, at the lowest score less 10, and then counts one byte piece for each of its UTF-8 bytes.

Texts are counted by chunk (see pieces); equal chunks of a task are counted once, in a table of bounded size.

Defined cases: a null or empty text has 0 tokens; equal rows each give a row; an empty table gives an empty one; only
the two named columns are read.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.llm import common as C
from scanledger.llm import pieces as P

UNKNOWN_PENALTY = 10.0
#: Chunks remembered by a task.
REMEMBERED = 400_000


def automaton(names: list[str], scores: list[float]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for name, score in zip(names, scores, strict=True):
        a.add_word(name, (len(name), score))
    a.make_automaton()
    return a


def count(chunk: str, found, single: set[str], unknown: float) -> int:
    """Pieces of the best path through one chunk (spaces escaped)."""
    best, pieces = [0.0] * (len(chunk) + 1), [0] * (len(chunk) + 1)
    edges = list(found.iter(chunk))
    at, n = 0, len(edges)
    for end, char in enumerate(chunk, 1):
        top = None
        while at < n and edges[at][0] < end:
            size, score = edges[at][1]
            score += best[end - size]
            if top is None or score > top:
                top, number = score, pieces[end - size] + 1
            at += 1
        if char not in single:
            score = best[end - 1] + unknown
            if top is None or score > top:
                top, number = score, pieces[end - 1] + len(char.encode())
        best[end], pieces[end] = top, number
    return pieces[-1]


def _count(batches, vocabulary):
    v = P.Pieces(**vocabulary.value)
    found, single, unknown = automaton(v.names, v.scores), {n for n in v.names if len(n) == 1}, v.lowest - UNKNOWN_PENALTY
    known: dict[str, int] = {}
    chunks = P.chunker(v.breaks)
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            total = 0
            for chunk in chunks(text or ""):
                n = known.get(chunk)
                if n is None:
                    n = count(chunk.replace(" ", P.SPACE), found, single, unknown)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[chunk] = n
                total += n
            out.append(total)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.int64())], names=["doc_id", "n_tokens"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: P.Pieces | None = None, model: str = P.MODEL) -> DataFrame:
    """(doc_id, n_tokens): pieces of each text under the unigram vocabulary (by default the pieces and scores of ``model``)."""
    told = C.prepare(docs.sparkSession).sparkContext.broadcast(vars(vocabulary or P.load(model)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(C.task(_count, vocabulary=told), "doc_id long, n_tokens long")


def op2(spark, sf_dir: str) -> DataFrame:
    return token_counts(C.table(spark, sf_dir, "documents"))
