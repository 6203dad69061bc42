"""The tables of the store: upsert, insertion, lookup, migration, and their Parquet form."""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators.common import broadcast_if_small
from quarry.schemas import METADATA_VERSION, RELATED


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """existing with the rows of new in place of those of the same key."""
    return existing.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_only(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """existing and the rows of new whose key it lacks."""
    return existing.unionByName(new.join(existing.select(*key), key, "left_anti"), allowMissingColumns=True)


def with_dimension(rows: DataFrame, dimension: int, name: str = "embedding") -> DataFrame:
    """rows; a vector of another length raises an error when it is read."""
    right = F.col(name).isNull() | (F.size(name) == dimension)
    message = F.concat(F.lit(f"a vector of {name} should have {dimension} components, not "), F.size(name).cast("string"))
    return rows.filter(F.when(right, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def lookup(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the ids asked for, in one semi-join."""
    return rows.join(ids.select(key), key, "left_semi")


def image_defaults(rows: DataFrame) -> DataFrame:
    """Empty strings, empty arrays and page 0 for what is missing."""
    out = {c: F.coalesce(c, F.lit("")) for c in ("vlm_caption", "ocr_text", "surrounding_context", "image_path", "related_text_content") if c in rows.columns}
    if "page" in rows.columns:
        out["page"] = F.coalesce("page", F.lit(0))
    if "related_text_chunks" in rows.columns:
        out["related_text_chunks"] = F.coalesce("related_text_chunks", F.array().cast(rows.schema["related_text_chunks"].dataType))
    return rows.withColumns(out)


def migrate(rows: DataFrame) -> DataFrame:
    """Metadata of the first version with the fields of the present one."""
    old = F.coalesce(F.col("metadata_version"), F.lit("1.0")) != METADATA_VERSION
    missing = {"related_text_chunks": RELATED, "related_chunk_ids": "array<string>", "related_text_content": "string"}
    rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in missing.items() if c not in rows.columns])
    return rows.withColumns(
        {
            "related_text_chunks": F.coalesce("related_text_chunks", F.array().cast(rows.schema["related_text_chunks"].dataType)),
            "related_chunk_ids": F.coalesce("related_chunk_ids", F.array().cast("array<string>")),
            "related_text_content": F.coalesce("related_text_content", F.lit("")),
            "migrated": old,
            "metadata_version": F.lit(METADATA_VERSION),
        }
    )


def flat_metadata(linked: Column, n: int = 500) -> Column:
    """The comma-joined, cut form of an id list, as a projection only."""
    return F.substring(F.array_join(linked.cast("array<string>"), ","), 1, n)


def as_json(rows: DataFrame, key: str = "id", updated: Column | None = None) -> DataFrame:
    """(key, metadata): all columns of a row but vectors and bytes as JSON, with the metadata's version and,
    where it is given, the time of the update. See metadata.read()."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shown = [c for c in rows.columns if kinds[c] not in ("binary", "array<float>", "array<double>") and c != "metadata_version"]
    more = [F.lit(METADATA_VERSION).alias("metadata_version"), *([] if updated is None else [updated.alias("last_updated")])]
    return rows.select(key, F.to_json(F.struct(*shown, *more), {"ignoreNullFields": "false"}).alias("metadata"))


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class Versions:
    """Numbered JSON files below a path, each made once. They are written aside and then renamed, so that
    nobody sees a part of one; on a shared file system such a rename succeeds for one writer only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        place, fs = self._fs(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n) for n in names if n.isdigit())

    def newest(self) -> int:
        """The largest number, 0 if there is none."""
        return max(self.numbers(), default=0)

    def read(self, number: int) -> dict:
        place, fs = self._fs(f"{self.path}/{number}")
        file = fs.open(place)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def publish(self, number: int, what: dict) -> None:
        """Make the file of a number; Conflict if there is one."""
        aside, fs = self._fs(f"{self.path}/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        place, _ = self._fs(f"{self.path}/{number}")
        kind = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(aside, place, how)
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(place):
                raise Conflict(f"{self.path} has a version {number} by another writer") from e
            raise

    def delete(self, path: str) -> None:
        place, fs = self._fs(path)
        fs.delete(place, True)


    def sweep(self, path: str, older_than: float) -> None:
        """Remove what lies below a path and is older than so many seconds."""
        place, fs = self._fs(path)
        for f in fs.listStatus(place) if fs.exists(place) else []:
            if f.getModificationTime() <= (time.time() - older_than) * 1000:
                fs.delete(f.getPath(), True)


@dataclass
class Snapshot:
    """What a version of a table consists of. leaves: (depth, bits) -> [folder, rows]; the rows of a leaf are
    those whose hash ends in its `depth` bits. A table without rows has one leaf without a folder. tags:
    the last batch of each stream that is in the version."""

    version: int = 0
    leaves: dict[tuple[int, int], list] = field(default_factory=lambda: {(0, 0): [None, 0]})
    schema: str | None = None
    tags: dict[str, int] = field(default_factory=dict)

    @property
    def depth(self) -> int:
        return max(d for d, _ in self.leaves)

    def leaf_of(self, slot: int) -> tuple[int, int]:
        """The leaf of a row whose hash ends in the bits of slot."""
        return next((d, slot & ((1 << d) - 1)) for d in range(self.depth + 1) if (d, slot & ((1 << d) - 1)) in self.leaves)


def _schema(rows: DataFrame) -> str:
    """The schema of rows as JSON, everything nullable, as it is read from files."""
    text = json.dumps(rows.schema.jsonValue())
    for what in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{what}": false', f'"{what}": true')
    return text


def _name(leaf: tuple[int, int]) -> str:
    return f"{leaf[0]}_{leaf[1]}"


class Store:
    """Versioned Parquet tables below a path, in leaves of the hash of a key.

    A write rewrites the leaves that its rows fall into, in a folder of its own, and then makes the file of
    the next version, which says of each leaf where it is. Readers go by the newest file, so they see a write
    whole or not at all. A writer that finds its version taken puts its leaves on top of the new version,
    where that left them alone; else it removes its folder and starts anew from there. No data that a
    version names is written again or moved.

    A leaf that a write brings over leaf_rows rows is split by further bits of the hash, into leaves half
    full (extendible hashing), so the number of leaves follows the table. Rows of one key can't be split by
    its hash: a leaf of one key may be larger, but its rows are dealt to files of about file_rows rows, and no file
    has more than twice as many. The file of
    a version has a line for each leaf.
    """

    #: Bytes of a row group, of which a reader takes thousands of rows at a time, images among them.
    ATTEMPTS, ROW_GROUP = 20, 32 << 20

    def __init__(self, spark: SparkSession, path: str, leaf_rows: int = 1 << 15, file_rows: int = 1 << 15):
        self.spark, self.path, self.leaf_rows, self.file_rows = spark, path.rstrip("/"), leaf_rows, file_rows

    def versions(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.path}/{name}/versions")

    def version(self, name: str) -> int:
        """The newest version of a table, 0 if there is none."""
        return self.versions(name).newest()

    def snapshot(self, name: str, version: int | None = None) -> Snapshot:
        version = self.version(name) if version is None else version
        if not version:
            return Snapshot()
        found = self.versions(name).read(version)
        return Snapshot(version, {(d, b): [folder, rows] for d, b, folder, rows in found["leaves"]}, found["schema"], found["tags"])

    def _read(self, name: str, held: Snapshot, leaves: list | None = None) -> DataFrame | None:
        if held.schema is None:
            return None
        leaves = held.leaves if leaves is None else leaves
        paths = [f"{self.path}/{name}/data/{held.leaves[x][0]}/leaf={_name(x)}" for x in leaves if held.leaves[x][0]]
        kind = StructType.fromJson(json.loads(held.schema))
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """The rows of the newest version, or of another that vacuum() has left."""
        return self._read(name, self.snapshot(name, version))

    def changed(self, name: str, a: Snapshot, b: Snapshot) -> DataFrame:
        """The rows of version a in the leaves that version b has otherwise or not."""
        return self._read(name, a, [x for x, v in a.leaves.items() if b.leaves.get(x) != v])

    def find(self, name: str, keys: DataFrame, key: str) -> DataFrame | None:
        """The rows of the keys asked for; only their leaves are read. key: the column whose hash deals the rows."""
        held = self.snapshot(name)
        rows = self._read(name, held, [x for x, _ in self._counts(held, keys.select(key), key)])
        return None if rows is None else lookup(rows, keys, key)

    def _dealt(self, rows: DataFrame, held: Snapshot, key: str) -> DataFrame:
        """rows with the depth and bits of their leaf, and the files of it that are to be written."""
        slots = [(s, *x, max(1, -(-held.leaves[x][1] // self.file_rows))) for s in range(1 << held.depth) for x in (held.leaf_of(s),)]
        slots = broadcast_if_small(self.spark.createDataFrame(slots, "_slot long, _depth int, _bits long, _files int"))
        own = F.xxhash64(key).bitwiseAND(F.lit((1 << held.depth) - 1))
        return rows.withColumn("_slot", own).join(slots, "_slot").drop("_slot")

    def _counts(self, held: Snapshot, rows: DataFrame, key: str) -> list:
        """The leaves that rows fall into, and how many do."""
        found = self._dealt(rows.select(key), held, key).groupBy("_depth", "_bits").agg(F.count(F.lit(1)).alias("n")).collect()
        return sorted(((r["_depth"], r["_bits"]), r["n"]) for r in found)

    def add(self, name: str, new: DataFrame, key: list[str], replace: bool = True, whole: list[str] | None = None, tag: tuple[str, int] | None = None) -> DataFrame:
        """Upsert by key, or insertion of new keys only; an empty batch changes nothing. With `whole` (the
        first columns of the key) all old rows that share these with a new one go. With `tag`, the name of a
        stream and the number of a batch, a batch that a version has already is left out."""
        for attempt in range(self.ATTEMPTS):
            base = self.snapshot(name)
            if tag is not None and base.tags.get(tag[0], -1) >= tag[1]:
                return new if base.schema is None else self._read(name, base)
            counts = self._counts(base, new, key[0])
            if not counts and tag is None:
                return new if base.schema is None else self._read(name, base)
            folder = uuid.uuid4().hex
            made = self._write(name, base, counts, new, key, replace, whole, folder)
            touched = [x for x, _ in counts]
            while True:
                held = {x: v for x, v in base.leaves.items() if x not in touched} | made.leaves
                tags = base.tags | (dict([tag]) if tag is not None else {})
                schema = base.schema if not counts else made.schema
                try:
                    self._publish(name, Snapshot(base.version + 1, held, schema, tags))
                    return new if schema is None else self._read(name, Snapshot(base.version + 1, held, schema, tags))
                except Conflict:
                    now = self.snapshot(name)
                known = tag is not None and now.tags.get(tag[0], -1) >= tag[1]
                if known or now.schema != base.schema or any(now.leaves.get(x) != base.leaves[x] for x in touched):
                    self.versions(name).delete(f"{self.path}/{name}/data/{folder}")
                    break
                base = now  # the other writer was elsewhere: what was written can stay
            time.sleep(min(2.0, 0.05 * 2**attempt))
        raise Conflict(f"{name} was changed by others {self.ATTEMPTS} times meanwhile")

    def _write(self, name: str, base: Snapshot, counts: list, new: DataFrame, key: list[str], replace: bool, whole: list[str] | None, folder: str) -> Snapshot:
        """The touched leaves with the new rows, in a folder; split where they get too large."""
        rows = new.dropDuplicates(key)
        old = self._read(name, base, [x for x, _ in counts])
        if old is not None:
            rows = insert_only(old, rows, key) if not replace else upsert(old, rows, whole or key)
        if not counts:
            return Snapshot(leaves={}, schema=_schema(rows))
        leaves, split = {}, False
        for (d, b), n in counts:
            n += base.leaves[d, b][1]
            more = 0 if n <= self.leaf_rows else math.ceil(math.log2(2 * n / self.leaf_rows))
            leaves |= {(d + more, b | j << d): [folder, n >> more] for j in range(1 << more)}
            split |= more > 0
        tree = Snapshot(leaves={x: v for x, v in base.leaves.items() if x not in dict(counts)} | leaves)
        if split:  # a leaf of one key gets all of its rows
            for x, n in self._counts(tree, new, key[0]):
                leaves[x][1] = max(n, leaves[x][1])
        dealt = self._dealt(rows, tree, key[0])
        leaf = F.concat_ws("_", F.col("_depth").cast("string"), F.col("_bits").cast("string"))
        dealt = dealt.withColumn("leaf", leaf).withColumn("_file", F.pmod(F.xxhash64(*key), F.col("_files")))
        files = sum(max(1, -(-n // self.file_rows)) for _, n in leaves.values())
        path = f"{self.path}/{name}/data/{folder}"
        out = dealt.repartition(files, "leaf", "_file").sortWithinPartitions("leaf", *key).drop("_depth", "_bits", "_files", "_file")
        groups = {"parquet.block.size": self.ROW_GROUP}
        if any(kind == "binary" for _, kind in rows.dtypes):
            groups["parquet.block.row.count.limit"] = 256
        out.write.options(maxRecordsPerFile=2 * self.file_rows, **groups).partitionBy("leaf").parquet(path)
        done = self.spark.read.schema("leaf string").parquet(path).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        sizes = {tuple(map(int, r["leaf"].split("_"))): r["n"] for r in done.collect()}
        return Snapshot(leaves={x: [folder if x in sizes else None, sizes.get(x, 0)] for x in leaves}, schema=_schema(rows))

    def _publish(self, name: str, held: Snapshot) -> None:
        leaves = [[d, b, folder, rows] for (d, b), (folder, rows) in sorted(held.leaves.items())]
        self.versions(name).publish(held.version, {"leaves": leaves, "schema": held.schema, "tags": held.tags})

    def drop(self) -> None:
        """Remove all tables."""
        self.versions("").delete(self.path)

    def vacuum(self, name: str, keep: int = 1, older_than: float = 24 * 3600) -> None:
        """Remove all versions but the last `keep`, and the leaves that these don't use and that are older
        than so many seconds: what a writer is about to publish is younger."""
        versions = self.versions(name)
        numbers = versions.numbers()
        kept = [self.snapshot(name, v) for v in numbers[-keep:]]
        used = {(v[0], _name(x)) for s in kept for x, v in s.leaves.items()}
        place, fs = versions._fs(f"{self.path}/{name}/data")
        before = (time.time() - older_than) * 1000
        for folder in fs.listStatus(place) if fs.exists(place) else []:
            if folder.getModificationTime() <= before:
                own = {leaf for f, leaf in used if f == folder.getPath().getName()}
                for part in fs.listStatus(folder.getPath()):
                    if part.getPath().getName().removeprefix("leaf=") not in own:
                        fs.delete(part.getPath(), True)
                if not own:
                    fs.delete(folder.getPath(), True)
        for number in numbers[:-keep]:
            versions.delete(f"{versions.path}/{number}")
