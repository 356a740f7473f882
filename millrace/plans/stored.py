"""An inverted index on disk: segments, snapshots, merging, and incremental builds.

A commit adds a segment: postings (doc_id, term, tf, and the field's length and boost, so that a search needs no other table)
in a folder a bucket of terms, sorted by term; the documents; and the ids whose earlier entries it deletes. Nothing that is
written ever changes. What is valid is a version file: a JSON list of segments and deletions, each with the commit's number.
An entry is dead if its document was deleted by a later commit than its segment's. A version file is created under the next
number by a rename that fails if there is one, so of two writers one tries again on top of the other's version, and a
commit that dies leaves files that no version names.

A search reads a snapshot, that is, one version: later commits don't change what it sees. It prunes to its terms' buckets and,
by the statistics of the sorted files, to pages that can hold the terms; so its work grows with the postings of its terms.
"""

from __future__ import annotations

import gc
import json
import math
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import query_terms
from millrace.plans.index import IndexSpec, analysed, documents, matches
from millrace.sources.storage import Folder

POSTINGS = "doc_id bigint, field string, term string, tf bigint, length int, boost double, segment string, bucket int"
DOCUMENTS = "doc_id bigint, segment string"
DELETES = "doc_id bigint, deletes string"
#: Postings of a task that writes a segment, or ids of a file of marks; documents whose terms tell how many there will be and which are frequent; masks
#: of 64 ids each that are broadcast at most (some 64 MB), beyond which they are joined by a shuffle.
ROWS, LOOKED_AT, MASKS = 1_000_000, 20_000, 1 << 20


def _masks(ids: DataFrame, *by: str) -> DataFrame:
    """__chunk, __bits: the ids (doc_id) as one mask for each 64 neighbouring ones."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("doc_id").bitwiseAND(63).cast("int"))
    return ids.groupBy(F.shiftright("doc_id", 6).alias("__chunk"), *by).agg(F.bit_or(bit).alias("__bits"))


def _in_masks(key: str) -> Column:
    k = F.col(key).cast("bigint")
    return (F.shiftright(k, 6) == F.col("__chunk")) & (F.bit_get("__bits", k.bitwiseAND(63).cast("int")) == 1)


def _small(masks: DataFrame, n: int) -> DataFrame:
    return F.broadcast(masks) if n <= MASKS else masks


def _counted(parts: DataFrame) -> DataFrame:
    """doc_id, field, length, boost, term, tf of each row's own terms: runs of the sorted terms, so that nothing is shuffled."""
    own = parts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "field", "boost", F.sort_array("terms").alias("terms"))
    first = F.filter(F.slice(F.sequence(F.lit(0), F.size("terms")), F.lit(1), F.size("terms")), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    runs = own.select("doc_id", "field", "boost", "terms", F.size("terms").alias("length"), first.alias("first"))
    each = F.transform("first", lambda at, k: F.struct(F.get("terms", at).alias("term"), (F.coalesce(F.get("first", k + 1), F.col("length")) - at).cast("bigint").alias("tf")))
    return runs.select("doc_id", "field", "length", "boost", F.inline(each))


def _layout(terms: DataFrame, share: float) -> tuple[int, list[str]]:
    """(postings there will be, terms that make up a quarter of a task's rows or more), from `share` of all terms."""
    by_term = terms.groupBy("term").agg(F.count("*").alias("n"))
    row = by_term.agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") >= ROWS / 4 * share, F.col("term"))).alias("frequent")).first()
    return math.ceil((row.n or 0) / share), row.frequent


def _release(spark: SparkSession) -> None:
    """The shuffle files of what has been written are dropped when the driver collects its garbage: a second time, for what
    the first one lets go."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


@dataclass(frozen=True)
class Snapshot:
    """One version of an index, as it stays for whoever holds it."""

    index: StoredIndex
    manifest: dict

    @property
    def version(self) -> int:
        return self.manifest["version"]

    @property
    def segments(self) -> list[dict]:
        return self.manifest["segments"]

    def _table(self, kind: str, schema: str, names: list[str], label: str) -> DataFrame:
        spark, base = self.index.spark, f"{self.index.path}/{kind}"
        if not names:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/{label}={n}" for n in names))

    def _numbered(self, df: DataFrame, label: str, entries: list[dict]) -> DataFrame:
        """df with the number of the commit that its rows came with."""
        pairs = [F.lit(x) for e in entries for x in (e["id"], e["seq"])]
        return df.withColumn("seq", F.element_at(F.create_map(*pairs), F.col(label)) if pairs else F.lit(0))

    def _live(self, df: DataFrame, segments: list[dict]) -> DataFrame:
        rows = self._numbered(df, "segment", segments)
        least = min((e["seq"] for e in segments), default=0)
        later = [e for e in self.manifest["deletes"] if e["seq"] > least]
        if not later:
            return rows
        died = self._numbered(self._table("deletes", DELETES, [e["id"] for e in later], "deletes"), "deletes", later).withColumnRenamed("seq", "__died")
        masks = _small(_masks(died, "__died"), sum(e.get("masks", MASKS + 1) for e in later))
        return rows.join(masks, _in_masks("doc_id") & (F.col("__died") > F.col("seq")), "left_anti")

    def postings(self, terms: list[str] | None = None, segments: list[dict] | None = None) -> DataFrame:
        """doc_id, field, term, tf, length, boost of the live documents; of the given terms only those terms' buckets are read."""
        segments = self.segments if segments is None else segments
        found = self._table("postings", POSTINGS, [e["id"] for e in segments if e["postings"]], "segment")
        if terms is not None:
            found = found.filter(F.col("bucket").isin(*(self.index.bucket(F.lit(t)) for t in terms)) & F.col("term").isin(*terms))
        return self._live(found, segments).select("doc_id", "field", "term", "tf", "length", "boost")

    def documents(self, segments: list[dict] | None = None) -> DataFrame:
        """doc_id of the live documents."""
        segments = self.segments if segments is None else segments
        return self._live(self._table("documents", DOCUMENTS, [e["id"] for e in segments if e["documents"]], "segment"), segments).select("doc_id")

    def search(self, text: str, spec: IndexSpec) -> DataFrame:
        """doc_id, score, as plans.index.search() gives them for the live documents."""
        terms = query_terms(text)
        if text == "":
            return self.documents().withColumn("score", F.lit(1.0))
        if not terms:
            return self.documents().withColumn("score", F.lit(0.0)).limit(0)
        hits = self.postings(terms)
        counted = hits.groupBy("field", "term").agg(F.count("*").alias("df"))  # at most terms x fields rows
        idf = 1 + F.log(F.lit(self.manifest["live"]) / (F.col("df") + 1))
        weight = F.lit(1.0)
        for name, w in spec.weights.items():
            weight = F.when(F.col("field") == name, float(w)).otherwise(weight)
        one = F.sum(F.sqrt("tf") * idf * idf * F.col("boost") / F.sqrt("length"))
        by_field = matches(hits, terms).join(F.broadcast(counted), ["field", "term"]).groupBy("doc_id", "field").agg(one.alias("s"), F.count("*").alias("hit"))
        return by_field.groupBy("doc_id").agg(F.sum(weight * F.col("s") * F.col("hit") / len(terms)).alias("score"))


@dataclass(frozen=True)
class Pending:
    """A commit whose files are written, and that no version names yet."""

    index: StoredIndex
    id: str
    documents: int
    postings: int
    deletes: int
    masks: int
    replace: bool
    token: tuple[str, int] | None

    def publish(self) -> Snapshot:
        """Makes it the next version. A token (stream, batch) that was published before changes nothing."""
        while True:
            now = self.index.snapshot()
            old = now.manifest
            if self.token and old["applied"].get(self.token[0], -1) >= self.token[1]:
                return now
            seq, mine = old["next_seq"], [{"id": self.id, "seq": old["next_seq"], "documents": self.documents, "postings": self.postings}] if self.documents else []
            gone = 0
            if self.deletes and not self.replace:
                ids = self.index.spark.read.schema("doc_id bigint").parquet(f"{self.index.path}/deletes/deletes={self.id}")
                gone = now.documents().join(ids, "doc_id", "left_semi").count()
            deletes = [{"id": self.id, "seq": seq, "masks": self.masks}] if gone else []
            new = {
                "version": old["version"] + 1, "next_seq": seq + 1, "live": self.documents + (0 if self.replace else old["live"] - gone),
                "segments": ([] if self.replace else old["segments"]) + mine, "deletes": ([] if self.replace else old["deletes"]) + deletes,
                "applied": old["applied"] | ({self.token[0]: self.token[1]} if self.token else {}),
            }
            if self.index._publish(new):
                return Snapshot(self.index, new)


class StoredIndex:
    """buckets is fixed when the index is made; spec.key must be a whole number."""

    def __init__(self, spark: SparkSession, path: str, spec: IndexSpec, buckets: int = 16):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec
        self.folder = Folder(spark, self.path)
        if not self.folder.exists("versions/0000000000"):
            self._publish({"version": 0, "next_seq": 1, "live": 0, "segments": [], "deletes": [], "applied": {}, "buckets": buckets})
        self.buckets = json.loads(self.folder.read("versions/0000000000"))["buckets"]

    def _publish(self, manifest: dict) -> bool:
        self.folder._fs.mkdirs(self.folder._at("versions"))
        return self.folder.create(f"versions/{manifest['version']:010d}", json.dumps(manifest))

    def snapshot(self) -> Snapshot:
        """The newest version."""
        return Snapshot(self, json.loads(self.folder.read(f"versions/{self.folder.names('versions')[-1]}")))

    def bucket(self, term: Column) -> Column:
        """Of a literal, Catalyst knows it before it lists the folders."""
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, postings: DataFrame, documents: DataFrame, total: int, frequent: list[str]) -> tuple[str, int, int]:
        """(id, documents, postings) of a new segment. A task has one bucket's share of the terms, sorted, in a file; the
        frequent terms are dealt by doc_id to all tasks of their bucket. total: postings, roughly."""
        name = uuid.uuid4().hex
        each = max(1, math.ceil(total / ROWS / self.buckets))
        bucket, at = self.bucket(F.col("term")), F.hash("term").cast("bigint")
        if frequent:
            at = F.when(F.col("term").isin(*frequent), at + F.hash("doc_id")).otherwise(at)
        dealt = postings.repartitionById(self.buckets * each, bucket * each + F.pmod(at, F.lit(each)).cast("int"))
        dealt.withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={name}")
        documents.select("doc_id").write.parquet(f"{self.path}/documents/segment={name}")
        count = lambda kind, schema: self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/segment={name}").count()
        return name, count("documents", "doc_id bigint"), count("postings", "doc_id bigint")

    def stage(self, rows: DataFrame, deletes: DataFrame | None = None, *, replace: bool = False, token: tuple[str, int] | None = None) -> Pending:
        """Writes what a commit adds: rows to index, which take the place of those with the same key, and the deletion of
        further doc_ids. replace: the index then holds these rows alone (a rebuild)."""
        indexed = documents(rows, self.spec).select(F.col(self.spec.key).cast("bigint").alias("doc_id"))
        n, n_ids = indexed.count(), indexed.distinct().count()
        share = min(1.0, LOOKED_AT / max(1, n))
        total, frequent = _layout(_counted(analysed(rows if share == 1 else rows.sample(share, seed=1), self.spec)), share)
        postings = _counted(analysed(rows, self.spec))
        if n > n_ids:  # rows that share a key are one document
            postings = postings.groupBy("doc_id", "field", "term").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"), F.max("boost").alias("boost"))
        name, n_documents, n_postings = self._write(postings, indexed.distinct(), total, frequent)
        ids = rows.select(F.col(self.spec.key).cast("bigint").alias("doc_id"))
        if deletes is not None:
            ids = ids.unionByName(deletes.select(F.col("doc_id").cast("bigint").alias("doc_id")))
        n_deletes = n_masks = 0
        if not replace:
            ids.distinct().write.parquet(f"{self.path}/deletes/deletes={name}")
            written = self.spark.read.schema("doc_id bigint").parquet(f"{self.path}/deletes/deletes={name}")
            n_deletes, n_masks = written.agg(F.count("*"), F.count_distinct(F.shiftright("doc_id", 6))).first()
        del postings, indexed, ids
        if n_postings > ROWS:
            _release(self.spark)
        return Pending(self, name, n_documents, n_postings, n_deletes, n_masks, replace, token)

    def commit(self, rows: DataFrame, deletes: DataFrame | None = None, *, replace: bool = False, token: tuple[str, int] | None = None) -> Snapshot:
        now = self.snapshot()
        if token and now.manifest["applied"].get(token[0], -1) >= token[1]:
            return now
        return self.stage(rows, deletes, replace=replace, token=token).publish()

    def merge(self, fan: int = 4) -> Snapshot:
        """While `fan` or more segments are of one size tier (powers of fan, by postings), writes their live entries as one
        segment and publishes the version with it. Deletions that no segment is older than go."""
        while True:
            now = self.snapshot()
            tiers: dict[int, list[dict]] = {}
            for e in now.segments:
                tiers.setdefault(int(math.log(max(1, e["postings"]), fan)), []).append(e)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fan), None)
            if full is None:
                return now
            total = sum(e["postings"] for e in full)
            share = min(1.0, ROWS / max(1, total))
            terms = now._table("postings", POSTINGS, [e["id"] for e in full if e["postings"]], "segment").select("term").sample(share, seed=1)
            name, documents, postings = self._write(now.postings(segments=full), now.documents(full), total, _layout(terms, share)[1])
            # what is alive in this version was deleted by none of its commits, so the segment counts as the newest of them
            seq, taken = now.manifest["next_seq"] - 1, {e["id"] for e in full}
            mine = [{"id": name, "seq": seq, "documents": documents, "postings": postings}] if documents else []
            while True:
                latest = self.snapshot()
                old = latest.manifest
                if not taken <= {e["id"] for e in old["segments"]}:
                    break  # another merge took some of them: look again
                segments = [e for e in old["segments"] if e["id"] not in taken] + mine
                least = min((e["seq"] for e in segments), default=old["next_seq"])
                new = old | {"version": old["version"] + 1, "segments": segments, "deletes": [e for e in old["deletes"] if e["seq"] > least]}
                if self._publish(new):
                    break

    def vacuum(self, keep: int = 2) -> None:
        """Removes what none of the newest `keep` versions names. Snapshots of older versions, and commits that are staged but
        not published, are lost."""
        names = self.folder.names("versions")
        kept = [json.loads(self.folder.read(f"versions/{n}")) for n in names[-keep:]]
        segments, deletes = {e["id"] for m in kept for e in m["segments"]}, {e["id"] for m in kept for e in m["deletes"]}
        for kind, label, used in (("postings", "segment", segments), ("documents", "segment", segments), ("deletes", "deletes", deletes)):
            for n in self.folder.names(kind):
                if n.partition("=")[2] not in used:
                    self.folder.delete(f"{kind}/{n}")
        for n in names[1:-keep]:
            self.folder.delete(f"versions/{n}")


class Searcher:
    """Holds a snapshot, and takes the newest one when asked to."""

    def __init__(self, index: StoredIndex):
        self.index, self.snapshot = index, index.snapshot()

    def refresh(self) -> bool:
        """Whether there was a newer version."""
        newest = self.index.snapshot()
        changed, self.snapshot = newest.version != self.snapshot.version, newest
        return changed

    def search(self, text: str) -> DataFrame:
        return self.snapshot.search(text, self.index.spec)


class DirtyMarks:
    """Ids whose documents are to be indexed anew. A mark is a row of a file that is only ever added; the marks that a drain
    has dealt with are listed beside them, so that an id marked again meanwhile stays marked."""

    SCHEMA = "doc_id bigint, mark string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)

    def mark(self, ids: DataFrame) -> None:
        """A file for each ROWS ids: a drain's batches are counted in files, and each is a pass over the entities."""
        name = uuid.uuid4().hex
        marked = ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
        marked.coalesce(max(1, math.ceil(marked.count() / ROWS))).withColumn("mark", F.lit(name)).write.mode("append").parquet(f"{self.path}/marks")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}") if self.folder.exists(name) else self.spark.createDataFrame([], self.SCHEMA)

    def pending(self) -> DataFrame:
        return self._read("marks").join(self._read("done"), ["doc_id", "mark"], "left_anti")

    def stream(self, files_per_trigger: int = 1000) -> DataFrame:
        return self.spark.readStream.schema(self.SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{self.path}/marks")

    def remove(self, batch: DataFrame, batch_id: int) -> None:
        """Again for the same batch, it replaces what it wrote."""
        batch.select("doc_id", "mark").write.mode("overwrite").parquet(f"{self.path}/done/{batch_id:010d}")


def incremental_build(index: StoredIndex, marks: DirtyMarks, entities: DataFrame, checkpoint: str, *, name: str = "dirty", files_per_trigger: int = 1000, seconds: int | None = None) -> Snapshot:
    """Drains the marks: each micro-batch commits the marked entities (a marked id without one is deleted) and only then
    removes its marks. A run that ends between the two does the same batch again; the index knows its number and stays, so
    the marks alone go. It takes as long as the marked entities need, unless the caller sets a limit in seconds."""

    def drained(batch: DataFrame, batch_id: int) -> None:
        ids = batch.select("doc_id").distinct()
        masks = _masks(ids)
        rows = entities.join(_small(masks, masks.count()), _in_masks(index.spec.key), "left_semi")
        index.commit(rows, ids, token=(name, batch_id))
        marks.remove(batch, batch_id)

    query = marks.stream(files_per_trigger).writeStream.foreachBatch(drained).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the build didn't end in {seconds} s")
    return index.snapshot()
