"""Deduplicating new batches against all history: a persisted inverted file of vector cells.

A text is the 0/1 vector of its distinct words; the distance of two texts is one minus their Jaccard similarity, and a
match is a vector within ``1 - threshold``. The cells of the file are centred on the axes of the word space: cell
(w, m, j) holds the vectors of norm ``m`` whose ``j``-th rarest axis is ``w``. For a query of norm ``n`` and a vector of
norm ``m`` to lie within the radius they must share ``o(n, m) = ceil(t (n + m) / (1 + t))`` axes; if their first common
axis has rank ``i`` in the query and ``j`` in the vector, at most ``min(n - i, m - j)`` are shared. That is the distance
bound of a cell: the query probes its axes from the rarest on, for each norm ``m`` only ranks ``i <= n - o`` and cells
``j <= m - o``, and stops where no cell can hold a nearer vector. The search is exact, not approximate; what the probed
cells yield is reranked on the full vectors. Frequent words have high ranks and are hardly ever probed.
(k-means cells were rejected: between sparse titles, distances to a centroid all lie between 0.8 and 1, so with a
radius of 0.2 the triangle bound excludes no cell and every probe would read the whole history.)

On disk an index is a folder of parquet tables, partitioned by batch and by bucket, so that a probe reads only the buckets
its own keys fall into (a partition filter of the scan) and shuffles none of the history where the batch is small:

* ``vectors``  name (128 bits), n, words - one row per distinct vector; bucket by name
* ``members``  name, id, seq - which records have the vector, and with which batch they came; bucket by name
* ``cells``    cell (w, m and j hashed to 64 bits), name - bucket by cell, sorted by cell
* ``keys``     kind, value, id, seq - exact identifiers; bucket by value
* ``order``    the ``COMMON`` most frequent words of the first history with their frequency; fixed for the life of the
  index, since both sides of a probe must rank axes alike. Other words rank before them.
* ``done``     an empty file per batch whose tables are complete, named by its tag and the number of buckets

A batch is probed first and appended then: ``probe`` holds it against what was accepted before, ``append`` adds its records,
and of its vectors those that are new. Batches have a tag. An append that stopped half way left no file in ``done``; its
files are not read and the next attempt replaces them, and a tag that is done is not appended again: a retried batch is
stored once. Nothing of the history is parsed or hashed again.

Defined results: null, empty and short texts (fewer than ``min_words`` distinct words) have no vector and match only by
identifier; placeholders are no identifiers; records of one batch are not held against each other; a row without a
batch number (null seq) matches nothing; repeated rows give one pair per pair of ids; an empty batch gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litquarry.llm.words import WordHashes, distinct_words, mix, set_sums
from litquarry.session import delete_on_exit, materialise, materialise_counted, release_driver, table_path

COMMON = 65_536
BUCKET_VECTORS = 50_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 4_096
BROADCAST_ROWS = 300_000  # of a few longs each, some MB
NAME = ["k1", "k2"]
VECTOR = "k1 long, k2 long, n int, words array<long>"


def _vectorise(min_words: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [distinct_words(t) if t else () for t in batch["text"]]
            keep = np.array([len(s) >= min_words for s in sets], bool)
            kept = [s for s, k in zip(sets, keep) if k]
            if not kept:
                continue
            n = np.fromiter(map(len, kept), "int64", len(kept))
            flat = np.fromiter((hashes[w] for s in kept for w in s), "uint64", int(n.sum()))
            starts = np.r_[0, n.cumsum()[:-1]]
            k1, k2 = set_sums(flat, starts)
            words = np.split(flat.view("int64"), starts[1:])
            yield pd.DataFrame({"id": batch["id"].to_numpy()[keep], "seq": batch["seq"].to_numpy()[keep], "k1": k1, "k2": k2,
                                "n": n.astype("int32"), "words": words})

    return read


def overlap_needed(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Common words two sets of n and m words need to reach the threshold."""
    return np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9).astype("int64")


def _cell(word: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    return mix(word.view("uint64") ^ mix((m * 4_096 + j).astype("uint64"), 0x1B873593), 0x52DCE729).view("int64")


def _ranked(batch: pd.DataFrame, words: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n by vector; vector, word and rank by element), elements in the fixed order: first-history frequency, then hash."""
    n = batch["n"].to_numpy("int64")
    flat = np.concatenate(batch["words"].to_list()).astype("int64")
    row = np.repeat(np.arange(len(n)), n)
    at = np.minimum(np.searchsorted(words, flat), max(len(words) - 1, 0))
    df = np.where(words[at] == flat, frequency[at], 0) if len(words) else np.zeros(len(flat), "int64")
    by = np.lexsort((flat, df, row))
    return n, row, flat[by], np.arange(len(flat)) - np.repeat(np.r_[0, n.cumsum()[:-1]], n)


def _file_cells(threshold: float, order: Broadcast):
    """The cells a vector is filed in: those some query could have to probe, ``j <= m - ceil(t m)``."""

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            n, row, word, rank = _ranked(batch, *order.value)
            own = rank <= n[row] - np.ceil(threshold * n[row] - 1e-9)
            row, word, rank = row[own], word[own], rank[own]
            yield pd.DataFrame({"cell": _cell(word, n[row], rank), "k1": batch["k1"].to_numpy()[row], "k2": batch["k2"].to_numpy()[row]})

    return file


def _probe_cells(threshold: float, order: Broadcast):
    """The cells a query has to probe: all (i, m, j) whose distance bound is within the radius."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            n, row, word, rank = _ranked(batch, *order.value)
            near = rank <= n[row] - np.ceil(threshold * n[row] - 1e-9)
            row, word, rank = row[near], word[near], rank[near]
            own = n[row]
            least = np.ceil(threshold * own - 1e-9).astype("int64")
            spread = np.floor(own / threshold + 1e-9).astype("int64") - least + 1
            pick = np.repeat(np.arange(len(row)), spread)
            m = least[pick] + np.arange(len(pick)) - np.repeat(np.r_[0, spread.cumsum()[:-1]], spread)
            o = overlap_needed(own[pick], m, threshold)
            fits = (rank[pick] <= own[pick] - o) & (o <= m)
            pick, m, o = pick[fits], m[fits], o[fits]
            js = m - o + 1
            again = np.repeat(np.arange(len(pick)), js)
            j = np.arange(len(again)) - np.repeat(np.r_[0, js.cumsum()[:-1]], js)
            src = row[pick[again]]
            yield pd.DataFrame({"cell": _cell(word[pick[again]], m[again], j), "q1": batch["k1"].to_numpy()[src], "q2": batch["k2"].to_numpy()[src]})

    return probe


TABLES = {"vectors": VECTOR, "members": "k1 long, k2 long, id long, seq int", "cells": "cell long, k1 long, k2 long",
          "keys": "kind string, value string, id long, seq int"}


def _buckets_for(vectors: int) -> int:
    """Buckets of a history: about BUCKET_VECTORS vectors each, within bounds that keep files and folders few."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, vectors // BUCKET_VECTORS).bit_length()))


def _asking(rows: DataFrame, at_most: int) -> DataFrame:
    """The side of a batch in a join with the history: broadcast if it is known to be small, else joined by shuffle."""
    return F.broadcast(rows) if at_most <= BROADCAST_ROWS else rows


class Prepared(NamedTuple):
    """Records as probe and append read them; written once, partitioned by batch number."""

    vectors: DataFrame  # id, k1, k2, n, words, seq
    keys: DataFrame | None  # kind, value, id, seq
    sizes: dict[int, int]  # batch number -> records with a vector
    identifiers: dict[int, int]  # batch number -> identifiers

    def batch(self, seq: int) -> Prepared:
        one = F.col("seq") == seq
        own = None if self.keys is None else self.keys.filter(one)
        return Prepared(self.vectors.filter(one), own, {seq: self.sizes.get(seq, 0)}, {seq: self.identifiers.get(seq, 0)})

    def distinct(self) -> DataFrame:
        """The distinct vectors: the sums of a set's hashes name it, and the first of equal rows is any of them."""
        return self.vectors.groupBy(*NAME).agg(F.first("n").alias("n"), F.first("words").alias("words"))


class CellIndex:
    """An index in a shared folder. ``create`` it from a first history; ``probe`` each new batch, then ``append`` it."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.8, min_words: int = 6):
        self.spark, self.path, self.threshold, self.min_words = spark, path, threshold, min_words
        self._order: Broadcast | None = None
        self._done: dict[str, int] | None = None

    @classmethod
    def create(cls, history: DataFrame, path: str | None = None, **options) -> CellIndex:
        """``history``: id, seq, text and any number of identifier columns already in comparable form (null: none)."""
        spark = history.sparkSession
        index = cls(spark, path or table_path(spark, "cells"), **options)
        index.append(history, "history")
        if path is None:
            delete_on_exit(spark, index.path)
        return index

    def _files(self):
        """(file system, folder of the marks of complete batches)."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def done(self) -> dict[str, int]:
        """Tags of the complete batches, with the number of buckets."""
        if self._done is None:
            fs, folder = self._files()
            names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
            self._done = {tag: int(n) for tag, _, n in (name.rpartition(".") for name in sorted(names))}
        return self._done

    @property
    def buckets(self) -> int:
        return next(iter(self.done().values()))

    def _table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table of the complete batches; only the listed buckets."""
        whole = self.spark.read.schema(f"{TABLES[name]}, batch string, bucket int").option("basePath", f"{self.path}/{name}")
        tags = sorted(self.done())
        table = whole.parquet(*(f"{self.path}/{name}/batch={t}" for t in tags)).filter(F.col("batch").isin(tags))
        return (table if buckets is None else table.filter(F.col("bucket").isin(buckets))).drop("batch")

    def _hit(self, placed: DataFrame, batch: Prepared) -> list[int] | None:
        """The buckets a batch asks for, at most MOST_BUCKETS; None (all) where it has records enough to ask for each."""
        if sum(batch.sizes.values()) > 4 * self.buckets:
            return None
        return [r[0] for r in placed.select("bucket").distinct().collect()]

    def _vectors(self, rows: DataFrame) -> DataFrame:
        return rows.filter("seq IS NOT NULL").select("id", "seq", "text").mapInPandas(_vectorise(self.min_words), f"id long, seq int, {VECTOR}")

    def order(self) -> Broadcast:
        """The fixed order, sent to each executor once: at most COMMON words, so bounded whatever the history."""
        if self._order is None:
            rows = self.spark.read.schema("word long, df long").parquet(f"{self.path}/order").orderBy("word").toPandas()
            self._order = self.spark.sparkContext.broadcast((rows["word"].to_numpy("int64"), rows["df"].to_numpy("int64")))
        return self._order

    def _cells(self, vectors: DataFrame) -> DataFrame:
        return vectors.select(*NAME, "n", "words").mapInPandas(_file_cells(self.threshold, self.order()), "cell long, k1 long, k2 long")

    def _probes(self, vectors: DataFrame) -> DataFrame:
        return vectors.select(*NAME, "n", "words").mapInPandas(_probe_cells(self.threshold, self.order()), "cell long, q1 long, q2 long")

    def _write(self, rows: DataFrame, name: str, tag: str, buckets: int, records: int) -> None:
        by = {"cells": F.col("cell"), "keys": F.xxhash64("kind", "value")}.get(name, F.col("k1"))
        placed = rows.withColumn("bucket", F.pmod(by, F.lit(buckets)).cast("int"))
        if records <= BUCKET_VECTORS:  # a small batch is one task's work
            placed = placed.coalesce(1)
        else:
            parts = -(-records // BUCKET_VECTORS)
            placed = placed.repartition(max(buckets, parts), "bucket", F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(-(-parts // buckets))))
        placed.sortWithinPartitions("bucket", rows.columns[0]).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={tag}")

    def prepare(self, rows: DataFrame) -> Prepared:
        """Vectors and identifiers of one batch or of several, written once. Needs nothing of the index."""
        vectors = materialise(self._vectors(rows).select("id", *NAME, "n", "words", "seq"), "vectors", "seq")
        sizes = {r.seq: r["count"] for r in vectors.groupBy("seq").count().collect()}
        kinds = [c for c in rows.columns if c not in ("id", "seq", "text")]
        if not kinds:
            return Prepared(vectors, None, sizes, {})
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds)))
        keys = rows.filter("seq IS NOT NULL").select("id", F.col("seq").cast("int").alias("seq"), each.alias("k")).filter("k.value IS NOT NULL")
        keys = materialise(keys.select("k.kind", "k.value", "id", "seq"), "keys", "seq")
        return Prepared(vectors, keys, sizes, {r.seq: r["count"] for r in keys.groupBy("seq").count().collect()})

    def append(self, rows: DataFrame | Prepared, tag: str) -> None:
        """Add a batch: id, seq, text, and identifier columns already in comparable form (null where there is none)."""
        if tag in self.done():
            return
        batch = rows if isinstance(rows, Prepared) else self.prepare(rows)
        one = batch.distinct()
        if self.done():
            buckets = self.buckets
            placed = one.select(*NAME, F.pmod("k1", F.lit(buckets)).cast("int").alias("bucket"))
            known = self._table("vectors", self._hit(placed, batch)).select(*NAME)
            # the names of the batch, which are few, meet the history; only what they find meets them again
            found = known.join(_asking(placed.select(*NAME), sum(batch.sizes.values())), NAME, "left_semi")
            one = one.join(found, NAME, "left_anti")
        else:
            buckets = _buckets_for(sum(batch.sizes.values()))
        records = sum(batch.sizes.values())
        self._write(one, "vectors", tag, buckets, records)
        new = self.spark.read.schema(f"{VECTOR}, bucket int").parquet(f"{self.path}/vectors/batch={tag}")
        if not self.done():
            df = new.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
            df.orderBy(F.desc("df"), "word").limit(COMMON).write.mode("overwrite").parquet(f"{self.path}/order")
        self._write(self._cells(new), "cells", tag, buckets, records)
        self._write(batch.vectors.select(*NAME, "id", "seq"), "members", tag, buckets, records)
        if batch.keys is not None:
            self._write(batch.keys.select("kind", "value", "id", "seq"), "keys", tag, buckets, sum(batch.identifiers.values()))
        fs, folder = self._files()
        fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{tag}.{buckets}"), True).close()  # the batch counts from here on
        self._done = {**self.done(), tag: buckets}

    def near_vectors(self, batch: Prepared) -> tuple[DataFrame, list[int] | None, int]:
        """(bucket, q1, q2, k1, k2: for each distinct vector of a batch, all within the radius; their buckets; at most so many)."""
        n, one = F.lit(self.buckets), batch.distinct()
        probes, n_probes = materialise_counted(self._probes(one).withColumn("bucket", F.pmod("cell", n).cast("int")), "probes")
        seen = self._table("cells", self._hit(probes, batch)).join(_asking(probes, n_probes), ["bucket", "cell"]).select("q1", "q2", *NAME).distinct()
        seen, n_seen = materialise_counted(seen.withColumn("bucket", F.pmod("k1", n).cast("int")), "probed")
        hit = self._hit(seen, batch)
        vectors = self._table("vectors", hit).select("bucket", *NAME, "words")
        vectors = vectors.join(_asking(seen.select("bucket", *NAME).distinct(), n_seen), ["bucket", *NAME], "left_semi")
        queries = one.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("words").alias("own"))
        ranked = seen.join(queries, ["q1", "q2"]).join(vectors, ["bucket", *NAME])
        shared = F.size(F.array_intersect("own", "words"))
        union = F.size("own") + F.size("words") - shared
        return ranked.filter(shared + 1e-9 >= F.lit(self.threshold) * union).select("bucket", "q1", "q2", *NAME), hit, n_seen

    def probe(self, rows: DataFrame | Prepared) -> DataFrame:
        """(known_id, new_id): the records of a batch (id, seq, text, identifiers) with what they repeat in the index."""
        batch = rows if isinstance(rows, Prepared) else self.prepare(rows)
        if not self.done():
            return batch.vectors.select(F.col("id").alias("known_id"), F.col("id").alias("new_id")).limit(0)
        n = F.lit(self.buckets)
        near, hit, at_most = self.near_vectors(batch)
        queries = batch.vectors.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("id").alias("new_id"), F.col("seq").alias("new_seq"))
        found = self._table("members", hit).join(_asking(near, at_most), ["bucket", *NAME]).join(queries, ["q1", "q2"])
        found = found.filter("seq < new_seq").select(F.col("id").alias("known_id"), "new_id")
        if batch.keys is not None:
            own = batch.keys.select("kind", "value", F.col("id").alias("new_id"), F.col("seq").alias("new_seq"), F.pmod(F.xxhash64("kind", "value"), n).cast("int").alias("bucket"))
            by_key = self._table("keys", self._hit(own, batch)).join(_asking(own, sum(batch.identifiers.values())), ["bucket", "kind", "value"])
            found = found.unionAll(by_key.filter("seq < new_seq").select(F.col("id").alias("known_id"), "new_id"))
        return found.distinct()

    def probe_and_append(self, rows: DataFrame | Prepared, tag: str) -> DataFrame:
        """``probe`` of a batch, written to the shared folder, and then ``append``; its texts are read once for both."""
        batch = rows if isinstance(rows, Prepared) else self.prepare(rows)
        found = materialise(self.probe(batch), "repeats")
        self.append(batch, tag)
        release_driver(self.spark)  # else the plans and broadcast rows of many batches stay until the heap is full
        return found


def _ascii_digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def doi_key(doi: Column) -> Column:
    """A doi from its ``10.`` on, lower-cased, without closing punctuation or spaces; null for placeholders."""
    found = F.regexp_extract(F.lower(_ascii_digits(doi)), r"(?s)(10\..*)", 1)
    bare = F.regexp_replace(found, r"[\s\p{P}\p{IsWhite_Space}]+$", "")
    return F.when(bare.rlike(r"^10\.[0-9]+/.") & ~bare.startswith("10.0000/"), bare)


def pmid_key(pmid: Column) -> Column:
    """A pmid by its digits without leading zeros; null where no non-zero digit is left."""
    digits = F.regexp_replace(F.regexp_replace(_ascii_digits(pmid), r"[^0-9]", ""), r"^0+", "")
    return F.when(digits != "", digits)
