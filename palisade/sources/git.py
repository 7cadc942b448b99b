"""Commits and their files out of a git folder, without the git program.

Spark reads loose objects and packs (binaryFile, so from any store; a pack over 2 GB is refused by it); one task inflates a pack. Ref names are few and are
read by the driver. Blobs over max_bytes are left out. Objects are inflated once, into the shared checkpoint folder.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.history import budgeted, reachable, tree_changes, walk_warnings
from palisade.plans.shared import checkpointed

# Object kinds of packs, with the two forms of deltas, and how often a tag may point to a tag.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
BY_OFFSET, BY_ID = 6, 7
MAX_TAGS = 16
CACHE_BYTES, PIECE = 64 << 20, 1 << 16


def git_folder(target: str) -> str | None:
    """The git folder of the repository that holds target, also of a linked working tree."""
    at = os.path.abspath(target)
    while True:
        found = os.path.join(at, ".git")
        if os.path.isdir(found):
            return found
        if os.path.isfile(found):
            with open(found, encoding="utf-8") as f:
                said = os.path.join(at, f.read().strip().removeprefix("gitdir: "))
            common = os.path.join(said, "commondir")
            if os.path.isfile(common):
                with open(common, encoding="utf-8") as f:
                    said = os.path.join(said, f.read().strip())
            return os.path.normpath(said)
        at, last = os.path.dirname(at), at
        if at == last:
            return None


def ref_tips(git: str) -> list[str]:
    """The distinct ids that refs name; a loose ref counts before a packed one of the same name."""
    named: dict[str, str] = {}
    packed = os.path.join(git, "packed-refs")
    if os.path.isfile(packed):
        with open(packed, encoding="utf-8", errors="replace") as f:
            named = {name: i for i, name in re.findall(r"(?m)^([0-9a-f]{40}) (\S+)$", f.read())}
    loose = [(os.path.join(folder, x), os.path.relpath(os.path.join(folder, x), git)) for folder, _, names in os.walk(os.path.join(git, "refs")) for x in names]
    for full, name in [*loose, (os.path.join(git, "HEAD"), "HEAD")]:
        if os.path.isfile(full):
            with open(full, encoding="utf-8", errors="replace") as f:
                said = f.read().strip()
            if re.fullmatch("[0-9a-f]{40}", said):
                named[name.replace(os.sep, "/")] = said
    return sorted(set(named.values()))


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of 7 bits a byte, the lowest first, and the place after it."""
    n = shift = 0
    while True:
        n |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return n, at


def patched(base: bytes, delta: bytes) -> bytes:
    """A delta applied: copies of stretches of the base, and new bytes."""
    _, at = _number(delta, 0)
    size, at = _number(delta, at)
    out = bytearray()
    while at < len(delta):
        op, at = delta[at], at + 1
        if op < 128:
            out += delta[at : at + op]
            at += op
            continue
        field = 0
        for bit in range(7):
            if op >> bit & 1:
                field |= delta[at] << (8 * bit)
                at += 1
        start, n = field & 0xFFFFFFFF, field >> 32 or 0x10000
        out += base[start : start + n]
    if len(out) != size:
        raise ValueError("a delta that does not fit its base")
    return bytes(out)


class Pack:
    """The objects of one pack; bodies are made when asked for, and some are remembered."""

    def __init__(self, data: bytes) -> None:
        self.data, self.places, self.ids = memoryview(data), {}, {}
        self.cache: OrderedDict[int, tuple[str, bytes]] = OrderedDict()
        self.held = 0
        if data[:4] != b"PACK":
            raise ValueError("not a pack")
        at = 12
        for _ in range(int.from_bytes(data[8:12], "big")):
            start = at
            kind = data[at] >> 4 & 7
            while data[at] > 127:
                at += 1
            at += 1
            base: int | bytes | None = None
            if kind == BY_OFFSET:
                back = data[at] & 127
                while data[at] > 127:
                    at += 1
                    back = (back + 1) << 7 | data[at] & 127
                base, at = start - back, at + 1
            elif kind == BY_ID:
                base, at = data[at : at + 20], at + 20
            body, inflater = at, zlib.decompressobj()
            while not inflater.eof:
                piece = self.data[at : at + PIECE]
                if not piece:
                    raise ValueError("a pack that ends early")
                inflater.decompress(piece)
                at += len(piece)
            at -= len(inflater.unused_data)
            self.places[start] = (kind, base, body, at)

    def body(self, start: int) -> tuple[str, bytes] | None:
        """Kind and bytes of the object there; None if a base is not known yet."""
        deltas = []
        at: int | None = start
        while at not in self.cache:
            if at is None:
                return None
            kind, base, begin, end = self.places[at]
            inflated = zlib.decompress(self.data[begin:end])
            if base is None:
                self._remember(at, (KINDS[kind], inflated))
                break
            deltas.append((at, inflated))
            at = self.ids.get(base) if isinstance(base, bytes) else base
        self.cache.move_to_end(at)
        kind, whole = self.cache[at]
        for place, delta in reversed(deltas):
            whole = patched(whole, delta)
            self._remember(place, (kind, whole))
        return kind, whole

    def _remember(self, at: int, found: tuple[str, bytes]) -> None:
        self.cache[at] = found
        self.held += len(found[1])
        while self.held > CACHE_BYTES and len(self.cache) > 1:
            self.held -= len(self.cache.popitem(last=False)[1][1])

    def objects(self) -> Iterator[tuple[str, str, bytes]]:
        left = list(self.places)
        while left:
            later = []
            for at in left:
                found = self.body(at)
                if found is None:
                    later.append(at)
                    continue
                i = hashlib.sha1(f"{found[0]} {len(found[1])}\0".encode() + found[1]).digest()
                self.ids[i] = at
                yield (i.hex(), *found)
            if len(later) == len(left):
                raise ValueError("a pack without the base of a delta")
            left = later


def _loose(path: str, content: bytes) -> Iterator[tuple[str, str, bytes]]:
    head, _, body = zlib.decompress(content).partition(b"\0")
    yield "".join(path.split("/")[-2:]), head.split(b" ")[0].decode(), body


def _inflate(packs: bool, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for i, kind, body in Pack(content).objects() if packs else _loose(path, content):
                    if kind != "blob" or len(body) <= max_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.string()), pa.array([kind], pa.string()), pa.array([body], pa.binary())], ["id", "kind", "body"])

    return run


def objects(spark: SparkSession, git: str, max_bytes: int = 4 << 20) -> DataFrame:
    """id, kind, body of all objects; one that is both loose and packed comes twice."""
    parts = []
    for packs, names in ((False, "?" * 38), (True, "*.pack")):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(f"{git}/objects")
        parts.append(files.select("path", "content").mapInArrow(_inflate(packs, max_bytes), "id string, kind string, body binary"))
    return parts[0].unionByName(parts[1])


def commits_of(found: DataFrame) -> DataFrame:
    """id, tree_id, parents, author, date, commit_time of the commits among objects."""
    head = F.substring_index(F.make_valid_utf8(F.col("body").cast("string")), "\n\n", 1)
    rows = found.where("kind = 'commit'").dropDuplicates(["id"]).select("id", head.alias("head"))
    time = F.regexp_extract("head", r"(?m)^committer .*> (-?\d+)", 1).try_cast("long")
    return rows.select(
        "id", F.regexp_extract("head", r"\Atree ([0-9a-f]{40})", 1).alias("tree_id"), F.regexp_extract_all("head", F.lit(r"(?m)^parent ([0-9a-f]{40})"), F.lit(1)).alias("parents"), F.regexp_extract("head", r"(?m)^author (.*>)", 1).alias("author"),
        F.date_format(F.to_utc_timestamp(F.timestamp_seconds(time), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), time.alias("commit_time"),
    )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tree, body in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), strict=True):
            rows, at = [], 0
            while at < len(body):
                end = body.index(b"\0", at)
                mode, _, name = body[at:end].partition(b" ")
                rows.append((tree, name.decode(errors="replace"), mode.decode(), body[end + 1 : end + 21].hex()))
                at = end + 21
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["tree_id", "name", "mode", "child"])


def entries_of(found: DataFrame) -> DataFrame:
    """tree_id, name, mode, child of the trees among objects."""
    return found.where("kind = 'tree'").dropDuplicates(["id"]).select("id", "body").mapInArrow(_entries, "tree_id string, name string, mode string, child string")


def peeled(spark: SparkSession, tips: list[str], found: DataFrame) -> DataFrame:
    """id of what refs name, through tags."""
    tags = found.where("kind = 'tag'").select("id", F.regexp_extract(F.make_valid_utf8(F.col("body").cast("string")), r"\Aobject ([0-9a-f]{40})", 1).alias("target")).distinct()
    out = spark.createDataFrame([(t,) for t in tips], "id string")
    for _ in range(MAX_TAGS):
        if out.join(tags, "id", "left_semi").isEmpty():
            break
        out = checkpointed(out.join(tags, "id", "left").select(F.coalesce("target", "id").alias("id")).distinct())
    return out


def is_shallow(git: str) -> bool:
    return os.path.isfile(os.path.join(git, "shallow"))


@dataclass
class History:
    """files as working_tree() has them; warnings(kind, message); how many commits were read, and whether there are more."""

    files: DataFrame
    warnings: DataFrame
    scanned: int
    truncated: bool


def history(spark: SparkSession, git: str, budget: int | None = 2000, max_bytes: int = 4 << 20) -> History:
    """The regular files that the newest commits, at most budget (None: all), changed against their first parents."""
    found = checkpointed(objects(spark, git, max_bytes))
    known = checkpointed(commits_of(found))
    reached = checkpointed(reachable(known, peeled(spark, ref_tips(git), found), checkpointed))
    chosen, truncated = (reached, False) if budget is None else budgeted(reached, budget)
    chosen = checkpointed(chosen)
    changed = tree_changes(chosen, known, checkpointed(entries_of(found)), checkpointed).where("mode LIKE '100%'")
    blobs = found.where(F.col("kind") == "blob").join(changed.select(F.col("blob_id").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
    rows = changed.join(blobs.select(F.col("id").alias("blob_id"), F.col("body").cast("string").alias("content")), "blob_id").join(chosen.select(F.col("id").alias("commit"), "author", "date"), "commit")
    files = rows.select("path", "content", F.lit("commit").alias("prov_kind"), F.col("commit").alias("sha"), "author", "date")
    return History(files, walk_warnings(chosen, truncated, budget or 0, is_shallow(git)), chosen.count(), truncated)


def history_files(spark: SparkSession, git: str, budget: int | None = 2000, max_bytes: int = 4 << 20) -> DataFrame:
    return history(spark, git, budget, max_bytes).files
