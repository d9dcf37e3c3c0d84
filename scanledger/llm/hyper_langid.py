"""Language ID with hyperdimensional profiles.

Every letter has a random vector of signs, made from its code point. A trigram (a letter with the letters, or word
edges, beside it) binds its three vectors, each permuted by its place: the product of their rolls by 2, 1 and 0. A
text's vector bundles (adds) all its trigrams; a language's prototype bundles all texts of the language. The
prediction is the language whose prototype has the largest cosine with the text; the score is that cosine, 0 at
least. Letters are lower-cased first; runs of other characters are word edges.

Prototypes learn from every row whose language is not null and that is not held out. They are sums over tasks; what
reaches the driver is one vector a language (at most ``MAX_LANGS``, else an error).

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learnt;
of equal cosines the first language by code point wins; equal rows each give a row; a null id is not held out; an
empty table gives an empty one; only the named columns are read, the language only to learn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanledger.llm import common as C

DIM = 1024
MAX_LANGS = 4096
UNKNOWN = "und"
#: Code points worked on together.
CHUNK = 1 << 20
#: Distinct trigrams whose vectors are held together.
SLICE = 2048


_FOLDED: dict[int, int] = {}


def letter(code: int) -> np.ndarray:
    """The sign vector of a lower-case letter; 0 is the word edge."""
    return np.random.Generator(np.random.PCG64(code)).integers(0, 2, DIM, np.int8) * np.int8(2) - np.int8(1)


def folded(code: int) -> int:
    """Code point of the lower-case letter, 0 for any other character."""
    if code not in _FOLDED:
        low = chr(code).lower()
        _FOLDED[code] = ord(low) if len(low) == 1 and low.isalpha() else code if chr(code).isalpha() else 0
    return _FOLDED[code]


def trigrams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each occurrence of a trigram: its text's number, and its row in the distinct trigrams (three code points each)."""
    raw = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    edge = np.zeros(1, np.uint32)
    doc = np.repeat(np.arange(len(raw)), [len(r) + 2 for r in raw])
    codes = np.concatenate([x for r in raw for x in (edge, r, edge)] or [edge[:0]])
    present = np.unique(codes)
    table = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.uint32)
    table[present] = [folded(int(c)) for c in present]
    codes = table[codes]
    keep = np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0) | (doc[1:] != doc[:-1])][: len(codes)]
    codes, doc = codes[keep], doc[keep]
    middle = np.flatnonzero(codes)
    alphabet, small = np.unique(codes, return_inverse=True)
    size = len(alphabet)
    ids = (small[middle - 1] * size + small[middle]) * size + small[middle + 1]
    seen, column = np.unique(ids, return_inverse=True) if size**3 > 1 << 24 else _ranked(ids, size**3)
    trigrams = np.stack([alphabet[seen // size // size], alphabet[seen // size % size], alphabet[seen % size]], 1) if len(seen) else np.zeros((0, 3), np.uint32)
    return doc[middle], column, trigrams


def _ranked(ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with its inverse, of numbers below ``most``, by counting."""
    seen = np.flatnonzero(np.bincount(ids, minlength=1))
    place = np.zeros(most, np.int32)
    place[seen] = np.arange(len(seen), dtype=np.int32)
    return seen, place[ids]


def bundles(owner: np.ndarray, column: np.ndarray, trigrams: np.ndarray, rows: int) -> np.ndarray:
    """The sum of the vectors of each owner's trigrams, worked out SLICE distinct trigrams at a time."""
    out = np.zeros((rows, DIM), np.float32)
    letters = np.unique(trigrams)
    vectors = np.stack([letter(int(c)) for c in letters]) if len(letters) else np.zeros((0, DIM), np.int8)
    rolled2, rolled1 = np.roll(vectors, 2, 1), np.roll(vectors, 1, 1)
    if len(trigrams) > SLICE:
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
    for begin in range(0, len(trigrams), SLICE):
        part = trigrams[begin : begin + SLICE]
        own = slice(*np.searchsorted(column, [begin, begin + SLICE])) if len(trigrams) > SLICE else slice(None)
        a, b, c = (np.searchsorted(letters, part[:, i]) for i in range(3))
        bound = rolled2[a] * rolled1[b] * vectors[c]
        counts = np.bincount(owner[own] * len(part) + (column[own] - begin), minlength=rows * len(part)).reshape(rows, len(part))
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out


def _groups(batch: pa.RecordBatch, column: str = "text"):
    """Rows (start, end) of a batch with about CHUNK characters and 256 texts at most, and their texts (null as empty)."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK or i - start >= 255 or i == len(texts) - 1:
            yield start, i + 1, texts[start : i + 1]
            start, held = i + 1, 0


def _learn(batches):
    """Each task's bundle of every language."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for start, end, texts in _groups(batch):
            doc, column, trigrams = trigrams_of(texts)
            names = sorted(set(langs[start:end]))
            of = np.array([names.index(x) for x in langs[start:end]])
            for name, v in zip(names, bundles(of[doc], column, trigrams, len(names)), strict=True):
                total[name] = total.get(name, 0) + v.astype(np.float64)
    schema = pa.schema([("lang", pa.string()), ("at", pa.int32()), ("value", pa.float64())])
    for name, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], schema=schema)


def learn(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and their prototypes scaled to length 1; languages without a letter are left out."""
    C.prepare(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    sums = C.stash(rows.mapInArrow(C.task(_learn), "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value")))
    n = sums.select("lang").distinct().count()
    if n > MAX_LANGS:
        raise ValueError(f"{n} languages; at most {MAX_LANGS} prototypes are held")
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v")).collect()
    named = {r["lang"]: np.array([x["value"] for x in r["v"]]) for r in found}
    names = sorted((x for x, v in named.items() if v.any()), key=lambda x: x.encode())
    return names, np.stack([named[x] / np.linalg.norm(named[x]) for x in names]) if names else np.zeros((0, DIM))


def _predict(batches, model):
    names, prototypes = model.value
    for batch in batches:
        preds, scores = [], []
        for _, _, texts in _groups(batch):
            doc, column, trigrams = trigrams_of(texts)
            n = np.bincount(doc, minlength=len(texts))
            vectors = bundles(doc, column, trigrams, len(texts))
            length = np.linalg.norm(vectors, axis=1)
            cosine = vectors @ prototypes.T.astype(np.float32) / np.maximum(length, 1e-30)[:, None]
            best = cosine.argmax(1) if names else np.zeros(len(texts), int)
            for i in range(len(texts)):
                known = bool(names) and n[i] > 0
                preds.append(names[best[i]] if known else UNKNOWN)
                scores.append(min(1.0, max(0.0, float(cosine[i, best[i]]))) if known else 0.0)
        rest = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])


def identify(docs: DataFrame, keys: list[Column], text_col: str, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The ``keys`` of each row with lang_pred and score."""
    C.prepare(docs.sparkSession)
    rows = docs.select(*keys, F.col(text_col).alias("text"))
    told = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGS vectors
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(C.task(_predict, model=told), f"{ddl}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()), "text", "lang")
    return identify(docs, [F.col("doc_id"), held_out().alias("held_out")], "text", model)
