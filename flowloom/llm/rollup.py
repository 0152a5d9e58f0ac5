"""Token counts by source, language and tokenizer version, maintained by deltas.

A store is a folder with data folders and a log.  A batch holds its documents'
new counts and the signed change of the totals they cause: an insert adds, a
delete takes back what the document had, a revision does both.  Totals are the
sum of all changes, so nothing is recounted.

A batch counts once the log names it.  Log entries are numbered files that only
one writer can create, so commits have one order: a writer that loses a number
takes its change again against the newer state.  A batch id that the log names
already is left alone, so replays and retries change nothing, and data folders
that a lost job left behind are never read.  Every ``COMPACT`` batches an entry
holds the whole state, and readers start from the last one.
"""

from __future__ import annotations

import base64
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: how the vocabulary's own tokenizer splits text before merging (fixed value)
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEY = ("source", "lang", "tokenizer")
DOCS = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint"
#: batches between entries of the whole state, and changed ids that are broadcast at most
COMPACT, MAX_BROADCAST_IDS = 32, 1_000_000
DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


class Tokenizer:
    """A vocabulary file and a version name; the file is read on the driver and sent to the executors."""

    def __init__(self, spark: SparkSession, path: str = VOCABULARY, version: str = "byte_bpe_50k.1", pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.sent = spark.sparkContext.broadcast(f.read())
        self.version, self.pattern = version, pattern

    def count(self, rows: DataFrame) -> DataFrame:
        """``rows(doc_id, source, lang, text)`` with ``tokens`` in place of the text; null texts have none."""
        sent, pattern = self.sent, self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in sent.value.splitlines() if x)}
            enc = tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for b in batches:
                n = [len(enc.encode_to_numpy(t, disallowed_special=())) if t else 0 for t in b.column(3).to_pylist()]
                cols = [b.column(i) for i in range(3)] + [pa.array(np.array(n, np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "source", "lang", "tokens"])

        d = rows.mapInArrow(run, "doc_id bigint, source string, lang string, tokens bigint")
        return d.withColumn("tokenizer", F.lit(self.version))


class TokenRollup:
    """``path`` must be in storage that all nodes share and that lets one of many writers create a file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    # the log

    def _entry(self, number: int, wait: float = 10.0) -> tuple[str, str, str, str] | None:
        """(kind, batch id, folder, change) of an entry, None if there is none."""
        p, fs = self._fs(f"{self.path}/log/{number:012d}")
        if not fs.exists(p):
            return None
        until = time.time() + wait
        while True:
            stream = fs.open(p)
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            if text.endswith("\n"):
                return tuple(text[:-1].split("\t"))
            if time.time() > until:
                raise RuntimeError(f"log entry {number} was never finished; remove {p.toString()} if its writer is gone")
            time.sleep(0.1)

    def _log(self) -> list[tuple[str, str, str, str]]:
        out = []
        while (e := self._entry(len(out) + 1)) is not None:
            out.append(e)
        return out

    def _append(self, number: int, *fields: str) -> bool:
        """Create entry ``number``; False if another writer has it."""
        p, fs = self._fs(f"{self.path}/log/{number:012d}")
        try:
            out = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        out.write(("\t".join(fields) + "\n").encode())
        out.close()
        return True

    def batches(self) -> list[str]:
        """Ids of the committed batches, in order."""
        return [b for kind, b, *_ in self._log() if kind == "batch"]

    # reading

    @staticmethod
    def _since_state(log):
        last = max((i for i, e in enumerate(log) if e[0] == "state"), default=0)
        return list(enumerate(log))[last:]

    def _current(self, log, ids: DataFrame | None = None) -> DataFrame:
        parts = None
        for seq, (_, _, folder, _) in self._since_state(log):
            d = self.spark.read.schema(DOCS).parquet(f"{self.path}/data/{folder}/docs")
            d = (d if ids is None else d.join(ids, "doc_id", "left_semi")).withColumn("seq", F.lit(seq))
            parts = d if parts is None else parts.union(d)
        if parts is None:
            return self.spark.createDataFrame([], DOCS)
        last = parts.groupBy("doc_id").agg(F.max_by(F.struct(*KEY, "tokens"), "seq").alias("r"))
        return last.select("doc_id", "r.*").where("tokens IS NOT NULL")

    def _totals(self, log) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/{change}" for _, (_, _, folder, change) in self._since_state(log)]
        t = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return t.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def current(self) -> DataFrame:
        """The latest row of each document that is not deleted; an empty store has none."""
        return self._current(self._log())

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer; null sources and languages are groups."""
        return self._totals(self._log())

    # writing

    def commit(self, batch_id: str, changes: DataFrame, tokenizer: Tokenizer) -> bool:
        """Apply ``changes(doc_id, op, text, source, lang)``; False if the batch was there already.

        ``op`` is insert, revise or delete; an insert of a known document is a
        revision, a delete of an unknown one does nothing.  If a batch names a
        document more than once the greatest (op, text, source, lang) counts.
        Null ids are skipped; null texts have no tokens; an empty batch is
        committed, too.  Other columns are ignored.
        """
        if "\t" in batch_id or "\n" in batch_id:
            raise ValueError("batch ids hold no tabs or line ends")
        log = self._log()
        if any(kind == "batch" and b == batch_id for kind, b, *_ in log):
            return False
        folder = uuid.uuid4().hex
        home = f"{self.path}/data/{folder}"
        one = changes.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "op", "source", "lang", "text")
        if one.groupBy("doc_id").count().where("count > 1").limit(1).count():
            w = one.groupBy("doc_id").agg(F.max(F.struct("op", "text", "source", "lang")).alias("r"))
            one = w.select("doc_id", "r.op", "r.source", "r.lang", "r.text")
        new = tokenizer.count(one.where("op <> 'delete'").select("doc_id", "source", "lang", "text")).select("doc_id", *KEY, "tokens")
        gone = one.where("op = 'delete'").select("doc_id", "source", "lang", F.lit(tokenizer.version).alias("tokenizer"), F.lit(None).cast("bigint").alias("tokens"))
        new.unionByName(gone).write.parquet(f"{home}/docs")
        docs = self.spark.read.schema(DOCS).parquet(f"{home}/docs")
        # every text was tokenized once, above; a lost race only takes the change again
        while True:
            plus = docs.where("tokens IS NOT NULL").select(*KEY, F.lit(1).alias("docs"), "tokens")
            if log:
                old = self._current(log, broadcast_if_small(docs.select("doc_id"), MAX_BROADCAST_IDS))
                plus = plus.union(old.select(*KEY, F.lit(-1).alias("docs"), (-F.col("tokens")).alias("tokens")))
            change = f"delta-{len(log) + 1}"
            plus.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{home}/{change}")
            if self._append(len(log) + 1, "batch", batch_id, folder, change):
                break
            log = self._log()
            if any(kind == "batch" and b == batch_id for kind, b, *_ in log):
                p, fs = self._fs(home)
                fs.delete(p, True)
                return False
        if len(self._since_state(log)) >= COMPACT:
            self.compact()
        return True

    def compact(self) -> bool:
        """Write the whole state as one entry; False if a commit came first."""
        log, folder = self._log(), uuid.uuid4().hex
        self._current(log).write.parquet(f"{self.path}/data/{folder}/docs")
        self._totals(log).write.parquet(f"{self.path}/data/{folder}/delta")
        return self._append(len(log) + 1, "state", "", folder, "delta")


def count_documents(docs: DataFrame, path: str) -> DataFrame:
    """Totals after inserting all ``docs``, revising those with ``doc_id % 10 = 1`` (upper-cased), deleting those with ``doc_id % 10 = 2``, and replaying both batches."""
    spark = docs.sparkSession
    store, tok = TokenRollup(spark, path), Tokenizer(spark)
    d = docs.select("doc_id", "text", "source", "lang")
    first = d.withColumn("op", F.lit("insert"))
    second = d.where("doc_id % 10 IN (1, 2)").withColumn("op", F.when(F.expr("doc_id % 10 = 1"), "revise").otherwise("delete"))
    second = second.withColumn("text", F.when(F.col("op") == "revise", F.upper("text")))
    for _ in range(2):
        store.commit("1-insert", first, tok)
        store.commit("2-change", second, tok)
    return store.totals()
