"""A versioned key-value table in a folder.

Writes are segments: Parquet folders that become part of the store when a manifest names them, all
of a batch or nothing. ``flush`` collapses the segments into a file of level 0, ``maintain``
compacts levels as their sizes ask for, and neither changes what any snapshot reads. Reads union the
segments and files of one version and let one aggregation find the newest visible entries; Parquet
statistics and Bloom filters prune inside files, the manifest's key ranges prune whole files. A file that holds
each of its keys once and meets no other part is read as it is, without that aggregation, and a scan with a limit
reads up to the key that the manifest shows to be far enough.

Any number of threads may write through one handle: they queue, and whoever gets the turn commits a group
for all that wait. Of two handles, the second one's commit fails, since its version number is taken.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerkv.operators import versions
from layerkv.operators.amplification import ENTRY_BYTES, RECORD_BYTES
from layerkv.plans.batch import WriteBatch, as_bytes
from layerkv.plans.manifest import File, Folder, Segment, Stretch, Version, decode, encode, stretches
from layerkv.plans.options import Options, WriteOptions, compaction_level, group_size, should_publish
from layerkv.schema import DELETION, ENTRY, LEVELS, MAX_SEQUENCE, VALUE, InvalidArgument, NotFound, StoreError

MANIFESTS, SEGMENTS, TABLES = "manifests", "segments", "tables"
#: So many keys are asked for by equality, which reaches a file's filters; more are joined.
FEW_KEYS = 16


class Snapshot:
    """A pinned sequence: reads at it see what was committed up to it."""

    def __init__(self, sequence: int):
        self.sequence = sequence


class Waiting:
    """A batch in the queue of writers."""

    def __init__(self, batch: WriteBatch, options: WriteOptions):
        self.batch, self.options, self.done, self.error = batch, options, False, None

    @property
    def wants_sync(self) -> bool:
        return self.options.sync and not self.options.use_default_policy


#: What the store counts, by the part of it that does the work.
COUNTED = {
    "write": ("writes", "write_groups", "writes_grouped", "user_bytes_written", "bytes_written_to_log"),
    "publish": ("publishes",),
    "flush": ("flushes", "flush_output_bytes", "flush_versions_dropped"),
    "compact": ("compactions", "files_moved", "compaction_input_bytes", "compaction_output_bytes"),
    "read": ("gets", "get_hits_tail", "files_probed", "files_pruned", "scan_entries_returned", "scan_entries_skipped"),
}


def within(some: list[Stretch], low: str, high: str | None) -> list[Stretch]:
    """Stretches that meet ``[low, high]``, without the parts of theirs that don't; what is left stays apart from the rest."""
    kept = [[p for p in s.parts if p.largest >= low and (high is None or p.smallest <= high)] for s in some if s.largest >= low and (high is None or s.smallest <= high)]
    return [found for parts in kept for found in stretches(parts)]


def chunks(some: list[Stretch], size: int) -> Iterator[list[Stretch]]:
    """Neighbouring stretches, closed when they reach ``size`` bytes."""
    chunk, held = [], 0
    for s in some:
        chunk.append(s)
        held += sum(p.file_size if isinstance(p, File) else p.size for p in s.parts)
        if held >= size:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.options, self.folder = spark, options, Folder(spark, path)
        self.version, self.snapshots, self.error = Version(), [], None
        self.pending: list[tuple[int, WriteBatch]] = []  # written but not yet published, with first sequences
        self.last_sequence, self.published_at = 0, time.monotonic()
        self.before_publish: Callable[[Version], None] | None = None
        self.counts = dict.fromkeys((name for names in COUNTED.values() for name in names), 0)
        self._turn, self._queue = threading.RLock(), deque()

    # Lifecycle

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        """Open or create. Segments that a crash left behind are merged into level 0, as on any reopening."""
        store = cls(spark, path, options or Options())
        if store.folder.exists():
            if store.options.error_if_exists:
                raise InvalidArgument(f"{path} exists")
        elif not store.options.create_if_missing:
            raise NotFound(path)
        for name in (MANIFESTS, SEGMENTS, TABLES):
            store.folder.make(name)
        store.version = store._latest()
        store.last_sequence = store.version.last_sequence
        if store.version.number == 0:
            store._commit(store.version.next())
        if store.version.segments:
            store.flush()
        store.remove_obsolete()
        return store

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Publishes what is pending; flushes nothing."""
        self.sync()

    def _latest(self) -> Version:
        names = [n for n in self.folder.names(MANIFESTS) if n.endswith(".json")]
        return decode(self.folder.read(f"{MANIFESTS}/{names[-1]}")) if names else Version()

    def _commit(self, version: Version) -> None:
        """Publish a version; after a failure the handle takes no more writes."""
        try:
            if self.before_publish:
                self.before_publish(version)
            self.folder.write_new(f"{MANIFESTS}/{version.number:012d}.json", encode(version))
        except Exception as e:
            self.error = e
            raise
        self.version = version
        self.counts["publishes"] += 1
        self.published_at = time.monotonic()

    def remove_obsolete(self, keep: tuple[Version, ...] = ()) -> list[str]:
        """Delete files that neither this version nor those in ``keep`` name. Plans made earlier may still read them: call it when none is left."""
        kept = (self.version, *keep)
        named = {s.path for v in kept for s in v.segments} | {"/".join(f.path.split("/")[:2]) for v in kept for f in v.files}
        numbers = {f"{v.number:012d}.json" for v in kept}
        gone = [f"{MANIFESTS}/{n}" for n in self.folder.names(MANIFESTS) if n not in numbers]
        gone += [f"{top}/{n}" for top in (SEGMENTS, TABLES) for n in self.folder.names(top) if f"{top}/{n}" not in named]
        for name in gone:
            self.folder.delete(name)
        return gone

    # Writes

    def put(self, key: bytes | str, value: bytes | str, options: WriteOptions = WriteOptions()) -> None:  # noqa: B008
        self.write(WriteBatch().put(key, value), options)

    def delete(self, key: bytes | str, options: WriteOptions = WriteOptions()) -> None:  # noqa: B008
        self.write(WriteBatch().delete(key), options)

    def write(self, batch: WriteBatch, options: WriteOptions = WriteOptions()) -> None:  # noqa: B008
        """Queue the batch; whoever has the turn commits it, together with others that wait."""
        waiting = Waiting(batch, options)
        self._queue.append(waiting)
        with self._turn:
            while not waiting.done:
                self._lead()
        if waiting.error:
            raise waiting.error

    def _lead(self) -> None:
        """Commit the first of the queue, with as many of those behind it as its group takes along."""
        queued = list(self._queue)
        group = queued[: group_size([w.batch.approximate_size for w in queued], [w.wants_sync for w in queued])]
        try:
            self.write_group([w.batch for w in group], group[0].options)
        except Exception as e:
            for w in group:
                w.error = e
        for w in group:
            self._queue.popleft()
            w.done = True

    def write_all(self, batches: list[WriteBatch]) -> None:
        """Queued batches in order, in as few commits as group sizes allow; each batch stays whole."""
        waiting = [Waiting(b, WriteOptions()) for b in batches]
        with self._turn:
            self._queue.extend(waiting)
            while not all(w.done for w in waiting):
                self._lead()
        for error in [w.error for w in waiting if w.error]:
            raise error

    def write_group(self, batches: list[WriteBatch], options: WriteOptions = WriteOptions()) -> None:  # noqa: B008
        merged = reduce(WriteBatch.append, batches, WriteBatch())
        with self._turn:
            if self.error:
                raise StoreError("an earlier write failed") from self.error
            if not len(merged):
                return
            if self.last_sequence + len(merged) > MAX_SEQUENCE:
                raise InvalidArgument("sequences are used up")
            self.pending = [*self.pending, (self.last_sequence + 1, merged)]
            self.last_sequence += len(merged)
            user = merged.user_bytes
            for name, n in (("writes", len(merged)), ("write_groups", 1), ("writes_grouped", len(batches)), ("user_bytes_written", user), ("bytes_written_to_log", user + RECORD_BYTES + ENTRY_BYTES * len(merged))):
                self.counts[name] += n
            if should_publish(self.options, options, (time.monotonic() - self.published_at) * 1000):
                self.sync()
            if self._tail_bytes() > self.options.memtable_size_bytes:  # the tail is bounded in either mode
                self.flush()
                if self.options.background_compaction:
                    self.maintain()

    def _tail_bytes(self) -> int:
        return sum(s.size for s in self.version.segments) + sum(b.approximate_size for _, b in self.pending)

    @staticmethod
    def _pending_rows(pending: list[tuple[int, WriteBatch]]) -> list[tuple]:
        return [(key, first + k, vtype, value if vtype == VALUE else None) for first, batch in pending for k, (vtype, key, value) in enumerate(batch.entries)]

    def sync(self) -> None:
        """Publish pending writes as one segment."""
        with self._turn:
            if not self.pending:
                return
            self._add_segment(self.spark.createDataFrame(self._pending_rows(self.pending), ENTRY).coalesce(1), self._pending_segment(self.pending), self.last_sequence)
            self.pending = []

    def _pending_segment(self, pending: list[tuple[int, WriteBatch]]) -> Segment:
        """Unpublished batches as a segment without a place."""
        entries = [e for _, batch in pending for e in batch.entries]
        keys = [key for _, key, _ in entries]
        return Segment(0, "", len(entries), sum(b.approximate_size for _, b in pending), sum(vtype == DELETION for vtype, _, _ in entries), min(keys).hex(), max(keys).hex())

    def _add_segment(self, entries: DataFrame, segment: Segment, last: int, streams: dict[str, int] | None = None) -> None:
        """Write and publish; ``segment`` gets its number and path here, and a size if it has none."""
        number = self.version.next_number
        name = f"{SEGMENTS}/{number:012d}-{uuid.uuid4().hex[:8]}"  # another writer may try the same number
        try:
            self._writer(entries, segment.rows).parquet(f"{self.folder.path}/{name}")
        except Exception as e:
            self.error = e
            raise
        segment = replace(segment, number=number, path=name, size=segment.size or self.folder.size(name))
        self._commit(self.version.next(next_number=number + 1, last_sequence=last, segments=(*self.version.segments, segment), streams=self.version.streams | (streams or {})))

    def write_frame(self, changes: DataFrame, stream: str | None = None, batch_id: int = 0, gapless: bool = False) -> int:
        """Apply a DataFrame ``ordinal, user_key, vtype, value`` as one batch; ordinals run from 0. Returns its rows.

        With ``stream``, a micro-batch that was applied before is left out, so replays change nothing. A caller that
        made the ordinals ``gapless`` spares the count of distinct ones, which shuffles them.
        """
        with self._turn:
            return self._write_frame(changes, stream, batch_id, gapless)

    def _write_frame(self, changes: DataFrame, stream: str | None, batch_id: int, gapless: bool) -> int:
        if self.error:
            raise StoreError("an earlier write failed") from self.error
        if stream is not None and self.version.streams.get(stream, -1) >= batch_id:
            return 0
        self.sync()
        key = F.col("user_key").cast("binary")
        asked = [F.count(F.lit(1)), F.count_if(F.col("vtype") == DELETION), F.hex(F.min(key)), F.hex(F.max(key))]
        rows, gone, smallest, largest, *ordinals = changes.agg(*asked, *([] if gapless else [F.min("ordinal"), F.max("ordinal"), F.count_distinct("ordinal")])).first()
        low, high, distinct = ordinals or (0, rows - 1, rows)
        if rows and (low != 0 or high != rows - 1 or distinct != rows):
            raise InvalidArgument("ordinals must run from 0 without gaps or repeats")
        if rows or stream is not None:
            value = F.when(F.col("vtype") == VALUE, F.coalesce(F.col("value").cast("binary"), F.lit(b"")))
            entries = changes.select(key.alias("user_key"), (F.col("ordinal").cast("long") + self.last_sequence + 1).alias("seq"), F.col("vtype").cast("int"), value.alias("value"))
            self.last_sequence += rows
            self._add_segment(entries, Segment(0, "", rows, 0, gone, (smallest or "").lower(), (largest or "").lower()), self.last_sequence, {stream: batch_id} if stream is not None else None)
            self.counts["writes"] += rows
        return rows

    # Reads

    def _read(self, *paths: str) -> DataFrame:
        """Entries of segments and files; a page that fails its checksum fails the read, unless options say not to look."""
        return self.spark.read.schema(ENTRY).option("parquet.page.verify-checksum.enabled", str(self.options.verify_checksums).lower()).parquet(*paths)

    def _entries(self, parts: Iterable[File | Segment], pending: list[tuple[int, WriteBatch]]) -> DataFrame:
        """All entries of published parts and of unpublished batches."""
        paths = [f"{self.folder.path}/{p.path}" for p in parts]
        found = [self._read(*paths)] if paths else []
        if pending or not found:
            found.append(self.spark.createDataFrame(self._pending_rows(pending), ENTRY))
        return reduce(DataFrame.unionByName, found)

    def log(self, low: bytes | str | None = None, high: bytes | str | None = None) -> DataFrame:
        """All stored entries, of files whose range meets ``[low, high]`` if given."""
        lo, hi = (None if k is None else as_bytes(k).hex() for k in (low, high))
        pending, version = self.pending, self.version  # in this order: what is published in between is in both, and reads the same
        files = version.between(lo, hi)
        self.counts["files_pruned"] += len(version.files) - len(files)
        segments = [s for s in version.segments if (lo is None or s.largest >= lo) and (hi is None or s.smallest <= hi)]
        return self._entries([*segments, *files], pending)

    def _stretches(self) -> tuple[list[Stretch], list[tuple[int, WriteBatch]]]:
        """The parts that a read sees, by key, and the unpublished batches among them."""
        pending, version = self.pending, self.version
        return (stretches([*version.files, *version.segments, self._pending_segment(pending)]) if pending else version.stretches), pending

    def _live(self, some: list[Stretch], pending: list[tuple[int, WriteBatch]], at: int) -> DataFrame:
        """Live rows of stretches; only those that aren't settled are resolved."""
        settled = [s.parts[0] for s in some if s.settled]
        open_parts = [p for s in some if not s.settled for p in s.parts]
        held = [p for p in open_parts if p.path]
        found = [versions.visible(self._entries(settled, []), at).where(F.col("vtype") == VALUE)] if settled else []
        if open_parts or not settled:
            found.append(versions.live(self._entries(held, pending if len(held) < len(open_parts) else []), at))
        return reduce(DataFrame.unionByName, found).select("user_key", "value")

    def _at(self, snapshot: Snapshot | None) -> int:
        return self.last_sequence if snapshot is None else snapshot.sequence

    def df(self, snapshot: Snapshot | None = None) -> DataFrame:
        """``user_key, value`` of live rows, for any query; equality and ranges on the key reach the scans."""
        return self._live(*self._stretches(), self._at(snapshot))

    def get(self, key: bytes | str, snapshot: Snapshot | None = None) -> bytes | None:
        """The value, or none if the key is absent or deleted."""
        key = as_bytes(key)
        self.counts["gets"] += 1
        for first, batch in reversed(self.pending):
            for k in range(len(batch.entries) - 1, -1, -1):
                vtype, name, value = batch.entries[k]
                if name == key and first + k <= self._at(snapshot):
                    self.counts["get_hits_tail"] += 1
                    return value if vtype == VALUE else None
        self.counts["files_probed"] += sum(f.holds(key.hex()) for f in self.version.files)
        row = versions.newest(self.log(key, key).where(F.col("user_key") == F.lit(key)), self._at(snapshot)).first()
        return bytes(row["value"]) if row and row["vtype"] == VALUE else None

    def multi_get(self, keys: list[bytes | str], snapshot: Snapshot | None = None) -> dict[bytes, bytes]:
        """Values of those keys that are live; the keys are asked in one job."""
        asked = sorted({as_bytes(k) for k in keys})
        if not asked:
            return {}
        return {bytes(r["user_key"]): bytes(r["value"]) for r in versions.live(self._asked(asked), self._at(snapshot)).collect()}

    def _asked(self, keys: list[bytes]) -> DataFrame:
        """All entries of some keys, in order: only files that may hold one are read, and few keys reach their filters."""
        pending, version = self.pending, self.version
        names = [k.hex() for k in keys]
        files = {f.number: f for k in names for f in version.between(k, k)}
        self.counts["files_pruned"] += len(version.files) - len(files)
        log = self._entries([*version.segments, *files.values()], pending)
        if len(keys) <= FEW_KEYS:
            return log.where(reduce(lambda a, b: a | b, [F.col("user_key") == F.lit(k) for k in keys]))
        frame = self.spark.createDataFrame([(k,) for k in keys], "user_key binary")
        return log.where(F.col("user_key").between(F.lit(keys[0]), F.lit(keys[-1]))).join(frame, "user_key", "left_semi")

    def scan(self, start: bytes | str | None = None, limit: int | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """Live rows in key order, from ``start`` on. With a limit, files behind the key that is surely far enough are left out."""
        at, low = self._at(snapshot), as_bytes(start or b"")
        some, pending = self._stretches()
        high = None
        if limit is not None:
            high = self.version.reach(low.hex(), limit, at, self._pending_segment(pending).deletions if pending else 0)
        some = within(some, low.hex(), high)
        rows = self._live(some, pending, at)
        if low:
            rows = rows.where(F.col("user_key") >= F.lit(low))
        if high is not None:
            rows = rows.where(F.col("user_key") <= F.lit(bytes.fromhex(high)))
        rows = rows.orderBy("user_key")
        return rows if limit is None else rows.limit(limit)

    def iterate(self, start: bytes | str | None = None, snapshot: Snapshot | None = None) -> Iterator[tuple[bytes, bytes]]:
        """A forward cursor; what it has passed is counted when it is closed or done: rows, and entries that it stepped over.

        Stretches are read one after another, as many at once as make a task for each core, so the first rows don't wait for a
        sort of the whole store.
        """
        at, low, returned, last, done = self._at(snapshot), as_bytes(start or b""), 0, None, False
        log = self.log(start)
        log = log.where(F.col("user_key") >= F.lit(low)) if low else log
        some, pending = self._stretches()
        try:
            for chunk in chunks(within(some, low.hex(), None), self.options.target_file_size * self.spark.sparkContext.defaultParallelism):
                rows = self._live(chunk, pending, at)
                rows = rows.where(F.col("user_key") >= F.lit(low)) if low else rows
                for row in rows.orderBy("user_key").toLocalIterator():
                    returned, last = returned + 1, bytes(row["user_key"])
                    yield last, bytes(row["value"])
            done = True
        finally:
            passed = log if done else log.where(F.col("user_key") <= F.lit(last)) if returned else log.limit(0)
            self.counts["scan_entries_returned"] += returned
            self.counts["scan_entries_skipped"] += passed.count() - returned

    # Snapshots

    def snapshot(self) -> Snapshot:
        taken = Snapshot(self.last_sequence)
        self.snapshots.append(taken)
        return taken

    def release(self, snapshot: Snapshot | None) -> None:
        if snapshot is not None and snapshot in self.snapshots:
            self.snapshots.remove(snapshot)

    def smallest_snapshot(self) -> int:
        return min([self.last_sequence, *(s.sequence for s in self.snapshots)])

    # Maintenance

    def _writer(self, entries: DataFrame, rows: int):
        """``rows``: keys that a file is expected to hold, for the size of its filter."""
        writer = entries.write.option("parquet.page.size", self.options.block_size_bytes).option("parquet.page.write-checksum.enabled", "true")
        if self.options.bloom_bits_per_key:
            missed = 0.6185**self.options.bloom_bits_per_key
            for name, value in (("enabled", "true"), ("expected.ndv", max(1, rows)), ("fpp", max(missed, 1e-9))):
                writer = writer.option(f"parquet.bloom.filter.{name}#user_key", str(value))
        return writer

    def _write_table(self, entries: DataFrame, level: int, n_files: int, rows: int, unique: bool) -> tuple[tuple[File, ...], int]:
        """Entries as sorted files of disjoint key ranges (a key is never split), and the next free number.

        A file's bounds are its first and its last row, so no aggregation has to hold keys.
        """
        number = self.version.next_number
        name = f"{TABLES}/{number:012d}-{uuid.uuid4().hex[:8]}"
        order = ["user_key", F.desc("seq")]
        placed = entries.repartitionByRange(n_files, "user_key") if n_files > 1 else entries.coalesce(1)
        self._writer(placed.sortWithinPartitions(*order), -(-rows // n_files)).parquet(f"{self.folder.path}/{name}")
        file, place = F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("at")
        written = self.spark.read.schema(ENTRY).parquet(f"{self.folder.path}/{name}")
        size = F.max("_metadata.file_size").alias("size")
        sums = written.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vtype") == DELETION).alias("gone"), F.max("seq").alias("last"), size).collect()  # one row for each file
        ends = self.spark.createDataFrame([(r["f"], k) for r in sums for k in {0, r["n"] - 1}], "f string, at bigint")
        bounds: dict[str, list[str]] = {}
        for r in written.select(file, place, F.lower(F.hex("user_key")).alias("k")).join(F.broadcast(ends), ["f", "at"]).collect():  # two rows for each file
            bounds.setdefault(r["f"], []).append(r["k"])
        found = sorted(sums, key=lambda r: min(bounds[r["f"]]))
        files = tuple(File(level, number + k, f"{name}/{r['f']}", r["n"], r["size"], r["gone"], r["last"], unique, min(bounds[r["f"]]), max(bounds[r["f"]])) for k, r in enumerate(found))
        return files, number + max(1, len(files))

    def flush(self) -> bool:
        """Collapse the tail into a run of level 0; nothing to do if it is empty. Deletions stay.

        A run is one file, or as many disjoint ones as the tail is times larger than a memory table.
        """
        with self._turn:
            return self._flush()

    def _flush(self) -> bool:
        self.sync()
        if not self.version.segments:
            return False
        tail = [f"{self.folder.path}/{s.path}" for s in self.version.segments]
        oldest = self.smallest_snapshot()
        kept = versions.collapse(self._read(*tail), oldest)
        rows = sum(s.rows for s in self.version.segments)
        size = sum(s.size for s in self.version.segments)
        files, after = self._write_table(kept, 0, max(1, -(-size // self.options.memtable_size_bytes)), rows, oldest == self.last_sequence)
        self._commit(self.version.next(next_number=after, segments=(), files=(*self.version.files, *files)))
        self.counts["flushes"] += 1
        self.counts["flush_output_bytes"] += sum(f.file_size for f in files)
        self.counts["flush_versions_dropped"] += rows - sum(f.rows for f in files)
        return True

    def pick_level(self) -> int | None:
        files = {k: len({f.run if k == 0 else f.path for f in self.version.level(k)}) for k in range(LEVELS)}  # level 0 counts runs
        return compaction_level(files, {k: sum(f.file_size for f in self.version.level(k)) for k in range(LEVELS)}, self.options)

    def compact_level(self, level: int) -> None:
        """Merge files of a level with those they meet one level down, dropping what no snapshot needs.

        Level 0 goes down whole, since its files overlap; another level gives the first file behind
        the key it last gave, beginning again at its end. A file that meets nothing there and from which nothing
        can be dropped goes down in the manifest alone.
        """
        with self._turn:
            self._compact_level(level)

    def _compact_level(self, level: int) -> None:
        inputs = self.version.level(level)
        if not inputs or level >= LEVELS - 1:
            return
        if level:
            behind = self.version.pointers.get(str(level), "")
            inputs = [next((f for f in inputs if f.largest > behind), inputs[0])]
        low, high = min(f.smallest for f in inputs), max(f.largest for f in inputs)
        merged = inputs + [f for f in self.version.level(level + 1) if f.meets(low, high)]
        bottom = not any(f.level >= level + 2 for f in self.version.files)
        pointers = self.version.pointers | ({str(level): high} if level else {})
        if level and len(merged) == 1 and merged[0].unique and not (bottom and merged[0].deletions):
            self._commit(self.version.next(files=tuple(replace(f, level=level + 1) if f is merged[0] else f for f in self.version.files), pointers=pointers))
            self.counts["compactions"] += 1
            self.counts["files_moved"] += 1
            return
        log = self._read(*(f"{self.folder.path}/{f.path}" for f in merged))
        oldest = self.smallest_snapshot()
        kept = versions.compact(log, oldest, bottom)
        size = sum(f.file_size for f in merged)
        files, after = self._write_table(kept, level + 1, -(-size // self.options.target_file_size), sum(f.rows for f in merged), oldest == self.last_sequence)
        gone = {f.number for f in merged}
        self._commit(self.version.next(next_number=after, files=tuple(f for f in self.version.files if f.number not in gone) + files, pointers=pointers))
        self.counts["compactions"] += 1
        self.counts["compaction_input_bytes"] += size
        self.counts["compaction_output_bytes"] += sum(f.file_size for f in files)

    def maintain(self) -> int:
        """Compact until no level asks for it; returns how often."""
        n = 0
        while (level := self.pick_level()) is not None:
            self.compact_level(level)
            n += 1
        return n

    def compact_all(self) -> None:
        """Flush, then maintain: levels within their budgets stay as they are."""
        self.flush()
        self.maintain()

    # Statistics

    def files(self) -> DataFrame:
        schema = "level int, number bigint, path string, rows bigint, file_size bigint, smallest string, largest string"
        return self.spark.createDataFrame([(f.level, f.number, f.path, f.rows, f.file_size, f.smallest, f.largest) for f in self.version.files], schema)

    def stats(self) -> DataFrame:
        """One row of counters since opening, with write amplification."""
        user = self.counts["user_bytes_written"]
        written = sum(self.counts[k] for k in ("bytes_written_to_log", "flush_output_bytes", "compaction_output_bytes"))
        row = self.counts | {"last_sequence": self.last_sequence, "write_amplification": written / user if user else 0.0}
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint'}" for k, v in row.items()))

    def level_summary(self) -> str:
        levels = [(k, self.version.level(k)) for k in range(LEVELS)]
        return " ".join(f"L{k}:{len(fs)}({sum(f.file_size for f in fs) // 1024}KiB)" for k, fs in levels if fs)
