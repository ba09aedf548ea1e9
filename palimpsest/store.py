"""The store: vertrees, versions, collections, arrays and events in one folder.

Data are Parquet directories, one an array (an immutable sorted run). All else is
a small catalogue: JSON, rewritten as a whole under the next number with a create
that fails if the number exists, so that of two writers one loses and no reader
sees half a change. An array counts from the moment a catalogue names it; what a
failed job leaves behind is never read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.keys import key_bytes, key_hash, order_key, validate
from palimpsest.operators import compaction, reads, resolve, stats
from palimpsest.schema import COUNTER_ADD, COUNTER_SET, LOG, MAX_INLINE_BYTES, OPS, TOMBSTONE, VALUE, StoreError
from palimpsest.versions import Version, VersionTree

#: Catalogues kept, the newest included.
KEPT_CATALOGUES = 100
#: Parts in which a merge can go on step by step; each takes whole keys.
MERGE_UNITS = 8
#: Arrays as they are stored: the first dimension beside the key, so that bounds on it skip files and row groups.
STORED = T.StructType([*LOG, T.StructField("first", T.BinaryType())])
EVENTS = "event_id long, ts long, cmd string, args array<long>"
#: Requests that are counted; sizes are bytes of keys and values written.
REQUESTS = ("gets", "big_gets", "puts", "puts_size", "big_puts", "big_puts_size", "range_queries")
_EMPTY = {"next_id": 1, "next_seq": 1, "vertrees": {}, "collections": {}, "arrays": {}, "events": 0, "event": None, "requests": {}, "discards": {}}


def _reason() -> Column:
    """Why a row (dims, op, n) cannot be stored, or null."""
    return F.coalesce(
        validate(F.col("dims")),
        F.when(~F.col("op").isin(*OPS) | F.col("op").isNull(), "EINVAL: operation"),
        F.when(F.col("op").isin(COUNTER_SET, COUNTER_ADD) & F.col("n").isNull(), "EINVAL: a counter needs 8 bytes"),
    )


class Store:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.requests: Counter = Counter()  # (collection id, kind), not yet in the catalogue
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in ("catalogue", "events"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))
        if not self._numbers():
            self._write(0, _EMPTY)

    # the catalogue

    def _numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/catalogue")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _write(self, number: int, state: dict) -> None:
        if not self._write_new("catalogue", number, state):
            raise StoreError(4, "another writer changed the catalogue")
        # readers work on the newest; older ones stay a while for those that just looked
        self._fs.delete(self._path(f"{self.root}/catalogue/{number - KEPT_CATALOGUES:012d}.json"), False)

    def _write_new(self, folder: str, number: int, what: dict) -> bool:
        """Write aside, then rename to a name that must not exist yet; False if it does."""
        aside, to = self._path(f"{self.root}/{folder}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/{folder}/{number:012d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(aside, to):
            self._fs.delete(aside, False)
            return False
        return True

    def state(self) -> dict:
        """The catalogue as it is now: the snapshot that one request works on."""
        number = self._numbers()[-1]
        stream = self._fs.open(self._path(f"{self.root}/catalogue/{number:012d}.json"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text) | {"number": number}

    def _change(self, state: dict, event: str, *args: int) -> None:
        """Publish a state with its event. Requests counted so far go along."""
        self._publish_event(state)
        state["events"] += 1
        state["event"] = {"event_id": state["events"], "ts": self._now(), "cmd": event, "args": list(args)}
        self._put_state(state)
        self._publish_event(state)

    def _put_state(self, state: dict) -> None:
        asked = self._asked(state)
        number = state.pop("number")
        self._write(number + 1, state | {"requests": asked})
        state |= {"number": number + 1, "requests": asked}
        self.requests.clear()

    def _publish_event(self, state: dict) -> None:
        """The newest event in a file of its own; a writer that fails before it leaves this to the next."""
        if (event := state["event"]) is not None and not self._fs.exists(self._path(f"{self.root}/events/{event['event_id']:012d}.json")):
            self._write_new("events", event["event_id"], event)

    def _asked(self, state: dict) -> dict:
        """Requests by collection id and kind: those of the catalogue, and what this process has made since."""
        asked = {k: dict(x) for k, x in state["requests"].items()}
        for (c, kind), n in self.requests.items():
            own = asked.setdefault(str(c), {})
            own[kind] = own.get(kind, 0) + n
        return asked

    def save_requests(self) -> None:
        """Put this process's request counts into the catalogue, as any change does."""
        self._put_state(self.state())

    def _now(self) -> int:
        return int(self.clock())

    def _id(self, state: dict) -> int:
        state["next_id"] += 1
        return state["next_id"] - 1

    @staticmethod
    def _tree(state: dict, vertree: int) -> VersionTree:
        if str(vertree) not in state["vertrees"]:
            raise StoreError(201)
        return VersionTree({x["v"]: Version(**x) for x in state["vertrees"][str(vertree)]["versions"]})

    @staticmethod
    def _keep(state: dict, vertree: int, tree: VersionTree) -> None:
        state["vertrees"][str(vertree)]["versions"] = [vars(x) for x in tree.versions.values()]

    def _find(self, state: dict, version: int) -> int:
        for k, t in state["vertrees"].items():
            if any(x["v"] == version for x in t["versions"]):
                return int(k)
        raise StoreError(10)

    @staticmethod
    def _collection(state: dict, name: str) -> dict:
        if name not in state["collections"]:
            raise StoreError("ENOTCONN", f"no collection {name}")
        return state["collections"][name]

    # vertrees, versions and collections

    def create_vertree(self, timestamped: bool = True) -> tuple[int, int]:
        """A new tree with its root version; user timestamps are on unless turned off."""
        s = self.state()
        tree, root = self._id(s), self._id(s)
        s["vertrees"][str(tree)] = {"root": root, "timestamped": timestamped, "discard_s": 0, "barrier": None, "pending_barrier": None, "versions": []}
        t = VersionTree()
        t.add(root, 0, self._now())
        self._keep(s, tree, t)
        self._change(s, "VERSION_TREE_CREATED", tree, root)
        return tree, root

    def set_discard_period(self, vertree: int, seconds: int) -> None:
        s = self.state()
        self._tree(s, vertree)
        s["vertrees"][str(vertree)]["discard_s"] = seconds
        self._change(s, "TOMBSTONE_DISCARD_SET", vertree, seconds)

    def attach(self, name: str, version: int) -> int:
        s = self.state()
        tree = self._tree(s, vertree := self._find(s, version))
        if tree.versions[version].deleted:
            raise StoreError(10)
        if name in s["collections"] or any(c["version"] == version for c in s["collections"].values()):
            raise StoreError("EEXIST", "the name or version is attached")
        s["collections"][name] = {"id": (k := self._id(s)), "vertree": vertree, "version": version, "read_only": not tree.is_mutable(version)}
        self._change(s, "COLLECTION_ATTACHED", k, version)
        return k

    def detach(self, name: str) -> None:
        s = self.state()
        c = self._collection(s, name)
        del s["collections"][name]
        s["requests"].pop(str(c["id"]), None)
        for kind in REQUESTS:
            self.requests.pop((c["id"], kind), None)
        self._change(s, "COLLECTION_DETACHED", c["id"], c["version"])

    def reattach(self, name: str, version: int) -> None:
        s = self.state()
        c = self._collection(s, name)
        if self._find(s, version) != c["vertree"]:
            raise StoreError("EBADE", "another tree")
        if any(x["version"] == version for n, x in s["collections"].items() if n != name):
            raise StoreError("EEXIST", "the version is attached")
        c |= {"version": version, "read_only": not self._tree(s, c["vertree"]).is_mutable(version)}
        self._change(s, "COLLECTION_REATTACHED", c["id"], version)

    def snapshot(self, name: str) -> int:
        """Freeze the collection's version and go on in a child; the frozen version comes back."""
        s = self.state()
        c = self._collection(s, name)
        tree, old = self._tree(s, c["vertree"]), c["version"]
        if not tree.is_mutable(old):
            raise StoreError("EROFS", "not a leaf")
        new = self._id(s)
        tree.add(new, old, self._now())
        self._keep(s, c["vertree"], tree)
        c["version"] = new
        self._change(s, "COLLECTION_SNAPSHOT", c["id"], old, new)
        return old

    def clone(self, version: int) -> int:
        """A new version below one that is frozen or not attached."""
        s = self.state()
        if version == 0:
            raise StoreError("EINVAL", "version 0")
        tree = self._tree(s, vertree := self._find(s, version))
        if tree.is_mutable(version) and any(c["version"] == version for c in s["collections"].values()):
            raise StoreError("EUNATCH", "an attached leaf")
        new = self._id(s)
        tree.add(new, version, self._now())
        self._keep(s, vertree, tree)
        self._change(s, "CLONE", version, new)
        return new

    def delete_version(self, version: int) -> None:
        s = self.state()
        tree = self._tree(s, vertree := self._find(s, version))
        if any(c["version"] == version for c in s["collections"].values()):
            raise StoreError("EBUSY", "the version is attached")
        gone = tree.delete(version)
        self._keep(s, vertree, tree)
        if gone:
            self._drop_tree(s, vertree)
        self._change(s, "TREE_DELETED" if gone else "VERSION_DELETED", vertree, version)

    def destroy_vertree(self, vertree: int) -> None:
        s = self.state()
        self._tree(s, vertree)
        if any(c["vertree"] == vertree for c in s["collections"].values()):
            raise StoreError("EBUSY", "the tree is attached")
        self._drop_tree(s, vertree)
        self._change(s, "VERSION_TREE_DESTROYED", vertree)

    @staticmethod
    def _drop_tree(s: dict, vertree: int) -> None:
        del s["vertrees"][str(vertree)]
        s["arrays"] = {k: a for k, a in s["arrays"].items() if a["vertree"] != vertree}
        s["merges"] = {k: m for k, m in s.get("merges", {}).items() if m["vertree"] != vertree}

    # writes

    def write(self, name: str, rows: DataFrame, order: str | None = None, counted_as: str = "puts") -> int:
        """Append rows (dims, op, value, n, uts) to a collection as one new array.

        ``order`` names a column of unique numbers that says which write came
        first; without it the order inside one call is undefined between equal
        keys. Rows whose key or operation is not allowed refuse the whole call; use
        ``rejects`` to see them. The array's id comes back.
        """
        s = self.state()
        c = self._collection(s, name)
        if c["read_only"] or not self._tree(s, c["vertree"]).is_mutable(c["version"]):
            raise StoreError("EROFS", "the version is frozen")
        self.requests[c["id"], counted_as] += 1
        if array := self._append(s, c["vertree"], c["version"], rows, order):
            self.requests[c["id"], f"{counted_as}_size"] += s["arrays"][str(array)]["bytes"]
        return array

    @staticmethod
    def rejects(rows: DataFrame) -> DataFrame:
        """The rows that cannot be stored, with the reason."""
        return rows.withColumn("reason", _reason()).where("reason is not null")

    def _append(self, s: dict, vertree: int, version: int, rows: DataFrame, order: str | None = None, data_age: int | None = None) -> int:
        rows = rows.select(*(F.col(f) if f in rows.columns else F.lit(None).cast(LOG[f].dataType).alias(f) for f in ("dims", "op", "value", "n", "uts")), (F.col(order) if order else F.monotonically_increasing_id()).cast("long").alias("__at"))
        array = self._id(s)
        age = array if data_age is None else data_age
        seq = F.col("__at") + s["next_seq"]
        log = rows.select(
            F.lit(vertree).cast("long").alias("vertree"), F.lit(array).cast("long").alias("array_id"), F.lit(age).cast("long").alias("data_age"), seq.alias("seq"), F.lit(version).cast("long").alias("v"),
            "dims", "op", "value", "n", F.coalesce("uts", F.lit(0)).cast("long").alias("uts"),
        )
        path = self._write_run(vertree, array, log)
        if (m := self._measure([path]))["reason"]:  # of what was written, so that the rows are not computed once more; no catalogue names it yet
            self._fs.delete(self._path(path), True)
            raise StoreError("EINVAL", m["reason"])
        return self._link(s, vertree, array, age, [path], "NEW_TREE_ADDED", m=m)

    def _write_run(self, vertree: int, array: int, log: DataFrame) -> str:
        """Rows sorted by key in a new folder, which no catalogue names yet."""
        path = f"{self.root}/arrays/{vertree}/{array}-{uuid.uuid4().hex[:8]}"
        by = (F.size("dims"), F.col("first"), F.col("dims"))  # the order of keys; plain columns compare faster than a struct
        out = log.select(*LOG.names, F.get("dims", F.lit(0)).alias("first")).repartitionByRange(*by).sortWithinPartitions(*by, F.col("v").desc())
        out.write.option("parquet.bloom.filter.enabled#first", "true").parquet(path)
        return path

    def _measure(self, paths: list[str]) -> dict:
        """What written runs come to, and a reason why some of their rows cannot be stored."""
        is_counter = F.col("op").isin(COUNTER_SET, COUNTER_ADD)
        size = F.when(is_counter, 16).otherwise(F.coalesce(F.length("value"), F.lit(0))) + key_bytes(F.col("dims"))
        return self.spark.read.schema(STORED).parquet(*paths).agg(
            F.count(F.lit(1)).alias("items"), F.sum(size).alias("bytes"), F.min("uts").alias("lo"), F.max("uts").alias("hi"), F.max("seq").alias("seq"), F.hex(F.min("first")).alias("low"), F.hex(F.max("first")).alias("high"),
            F.count_if(is_counter).alias("counters"), F.min(_reason()).alias("reason"),
        ).first().asDict()

    def _link(self, s: dict, vertree: int, array: int, age: int, paths: list[str], event: str, replaces: list[int] | None = None, m: dict | None = None) -> int:
        """Name written runs in the catalogue as one array, with its sizes and the bounds of what it holds (``m``, if measured already)."""
        m = m or self._measure(paths)
        if not m["items"] and not replaces:
            return 0  # nothing to link
        for k in replaces or []:
            s["arrays"].pop(str(k))
        s["arrays"][str(array)] = {
            "id": array, "vertree": vertree, "data_age": age, "level": 2, "paths": paths, "items": m["items"], "bytes": m["bytes"] or 0, "min_uts": m["lo"], "max_uts": m["hi"],
            "low": m["low"], "high": m["high"], "counters": m["counters"], "barrier": False, "state": "idle",
        }
        s["next_seq"] = max(s["next_seq"], (m["seq"] or 0) + 1)
        self._change(s, event, vertree, array)
        return array

    def put(self, name: str, rows: DataFrame, order: str | None = None) -> int:
        return self.write(name, rows.withColumn("op", F.lit(VALUE)), order)

    def remove(self, name: str, keys: DataFrame, order: str | None = None) -> int:
        return self.write(name, keys.withColumn("op", F.lit(TOMBSTONE)), order)

    def count(self, name: str, rows: DataFrame, add: bool = True, order: str | None = None) -> int:
        return self.write(name, rows.withColumn("op", F.lit(COUNTER_ADD if add else COUNTER_SET)), order)

    def put_chunks(self, name: str, parts: DataFrame) -> int:
        """Large values from rows (dims, chunk_no, chunk) and perhaps uts; values that fit inline are refused."""
        whole = reads.assemble(parts.withColumnRenamed("dims", "k"), "k").withColumnRenamed("k", "dims")
        if not whole.where(F.length("value") <= MAX_INLINE_BYTES).limit(1).isEmpty():
            raise StoreError("EINVAL", f"a value of at most {MAX_INLINE_BYTES} bytes is no large one")
        return self.write(name, whole.withColumn("op", F.lit(VALUE)), counted_as="big_puts")

    def stream_in(self, name: str, batches: DataFrame, column: str = "content", abort: bool = False) -> int:
        """Load batches of packed records as one array; all or nothing, 0 if aborted or empty."""
        from palimpsest.sources.streamin import decode

        if abort:
            return 0
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        try:
            # decoded once, by Python; a write computes its rows twice, for the ranges and for the run
            rows = decode(batches, column).withColumn("at", F.monotonically_increasing_id())
            rows.write.parquet(staged)
            return self.write(name, self.spark.read.schema(rows.schema).parquet(staged), order="at")
        finally:
            self._fs.delete(self._path(staged), True)

    # reads

    def log(self, vertree: int, state: dict | None = None, newer_than: int | None = None, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All entries of a tree, over the arrays that the catalogue names now.

        ``newer_than`` leaves out arrays without a greater user timestamp. ``low`` and
        ``high`` bound the first dimension: arrays beside them are not read, and
        in the others the bounds reach the Parquet scan.
        """
        s = state or self.state()
        own = [a for a in s["arrays"].values() if a["vertree"] == vertree and not a["barrier"] and (newer_than is None or (a["max_uts"] or 0) > newer_than)]
        own = [a for a in own if a["items"] and (low is None or bytes.fromhex(a["high"]) >= low) and (high is None or bytes.fromhex(a["low"]) <= high)]
        if not own:
            return self.spark.createDataFrame([], LOG)
        out = self.spark.read.schema(STORED).parquet(*(p for a in own for p in a["paths"]))
        if low is not None:
            out = out.where(F.col("first") >= F.lit(bytearray(low)))
        if high is not None:
            out = out.where(F.col("first") <= F.lit(bytearray(high)))
        return out.select(*LOG.names)

    @staticmethod
    def _counted(s: dict, vertree: int) -> bool:
        """Whether a tree may hold counters; catalogues of old do not say."""
        return any(a.get("counters", 1) for a in s["arrays"].values() if a["vertree"] == vertree and not a["barrier"])

    def _view(self, name: str, kind: str, low: bytes | None = None, high: bytes | None = None) -> tuple[dict, dict, DataFrame, VersionTree, bool]:
        s = self.state()
        c = self._collection(s, name)
        self.requests[c["id"], kind] += 1
        tree = self._tree(s, c["vertree"])
        return s, c, self.log(c["vertree"], s, low=low, high=high), tree, s["vertrees"][str(c["vertree"])]["timestamped"]

    @staticmethod
    def _stamped(rows: DataFrame, asked: bool, timestamped: bool) -> DataFrame:
        """User timestamps as asked for: null if not, refused where the tree has none."""
        if asked and not timestamped:
            raise StoreError("EINVAL", "the tree has no user timestamps")
        return rows if asked else rows.withColumn("uts", F.lit(None).cast("long"))

    def get(self, name: str, dims: list[bytes], tombstones: bool = False, user_timestamps: bool = False, kind: str = "gets") -> DataFrame:
        first = bytes(dims[0]) if dims else None
        s, c, log, versions, timestamped = self._view(name, kind, first, first)
        key = F.array(*(F.lit(bytearray(d)) for d in dims))
        return self._stamped(resolve.read(log.where(F.col("dims") == key), versions, ["dims"], c["version"], timestamped, tombstones, self._counted(s, c["vertree"])), user_timestamps, timestamped)

    def multi_get(self, name: str, wanted: DataFrame, user_timestamps: bool = False) -> DataFrame:
        s, c, log, versions, timestamped = self._view(name, "gets")
        return self._stamped(resolve.read(log.join(wanted.select("dims").distinct(), "dims", "left_semi"), versions, ["dims"], c["version"], timestamped, counted=self._counted(s, c["vertree"])), user_timestamps, timestamped)

    def get_chunks(self, name: str, dims: list[bytes], size: int) -> DataFrame:
        """(dims, chunk_no, chunk) of one value, cut into pieces of ``size`` bytes."""
        return reads.chunks(self.get(name, dims, kind="big_gets"), "dims", "value", size)

    def _inside(self, name: str, low: list[bytes | None], high: list[bytes | None], tombstones: bool, behind: list[bytes] | None = None, user_timestamps: bool = False) -> DataFrame:
        reads.check_bounds(low, low, high)
        least = max((bytes(x[0]) for x in (low, behind or [None]) if x[0] is not None), default=None)
        s, c, log, versions, timestamped = self._view(name, "range_queries", least, high[0])
        log = log.where(F.size("dims") == len(low))
        for i, (lo, hi) in enumerate(zip(low, high)):
            d = F.col("dims")[i]
            log = log.where(d >= F.lit(bytearray(lo))) if lo is not None else log
            log = log.where(d <= F.lit(bytearray(hi))) if hi is not None else log
        if behind is not None:
            log = log.where(F.col("dims") > F.array(*(F.lit(bytearray(d)) for d in behind)))
        return self._stamped(resolve.read(log, versions, ["dims"], c["version"], timestamped, tombstones, self._counted(s, c["vertree"])), user_timestamps, timestamped)

    def scan(self, name: str, low: list[bytes | None], high: list[bytes | None], tombstones: bool = False, values: bool = True, user_timestamps: bool = False) -> DataFrame:
        """Visible entries inside an inclusive box over keys of that many dimensions, in key order."""
        out = self._inside(name, low, high, tombstones, user_timestamps=user_timestamps).orderBy(order_key(F.col("dims")))
        return out if values else out.select("dims")

    def page(self, name: str, low: list[bytes | None], high: list[bytes | None], size: int, last: list[bytes] | None = None) -> DataFrame:
        """The next ``size`` visible entries of a box in key order, behind the key ``last``; what lies before it is not read."""
        return self._inside(name, low, high, False, last).orderBy("dims").limit(size)

    def read_counters(self, name: str) -> DataFrame:
        _, c, log, versions, _ = self._view(name, "range_queries")
        return resolve.counters(log, versions, ["dims"], c["version"])

    # merges

    def _check_merge(self, s: dict, vertree: int, arrays: list[int]) -> None:
        self._tree(s, vertree)
        own = {a["id"] for a in s["arrays"].values() if a["vertree"] == vertree}
        if any(a in {x["id"] for x in s["arrays"].values()} - own for a in arrays):
            raise StoreError(103)
        compaction.check_contiguous(self.arrays(s).where(F.col("vertree") == vertree), arrays)

    def _merged(self, s: dict, vertree: int, arrays: list[int], array: int, age: int, units: tuple[int, int] | None = None) -> DataFrame:
        """What the arrays hold after a merge; of the keys of some units, if these are given."""
        data = [a for a in s["arrays"].values() if a["vertree"] == vertree and not a["barrier"]]
        oldest = min(data, key=lambda a: a["data_age"])["id"] in arrays
        others = [a["min_uts"] for a in data if a["id"] not in arrays and a["min_uts"] is not None]
        meta = s["vertrees"][str(vertree)]
        log = self._inputs(s, arrays, units)
        counter = not self._inputs(s, arrays).where(F.col("op").isin(COUNTER_SET, COUNTER_ADD)).limit(1).isEmpty()
        out = compaction.merge(
            log, self._tree(s, vertree).frame(self.spark), ["dims"], timestamped=meta["timestamped"], counter=counter, oldest=oldest, now=self._now(), period=meta["discard_s"], least_other_uts=min(others) if others else None
        )
        fill = {"vertree": F.lit(vertree).cast("long"), "array_id": F.lit(array).cast("long"), "data_age": F.lit(age).cast("long"), "uts": F.coalesce("uts", F.lit(0)).cast("long")}
        return out.withColumns(fill).select(*LOG.names)

    def _inputs(self, s: dict, arrays: list[int], units: tuple[int, int] | None = None) -> DataFrame:
        log = self.spark.read.schema(LOG).parquet(*(p for a in arrays for p in s["arrays"][str(a)]["paths"]))
        return log if units is None else log.where(F.pmod(key_hash(F.col("dims")), F.lit(MERGE_UNITS)).between(units[0], units[1] - 1))

    def merge(self, vertree: int, arrays: list[int]) -> int:
        """Merge a contiguous run of arrays into one that takes their least age."""
        s = self.state()
        self._check_merge(s, vertree, arrays)
        array, age = self._id(s), min(s["arrays"][str(a)]["data_age"] for a in arrays)
        path = self._write_run(vertree, array, self._merged(s, vertree, arrays, array, age))
        self._count_discards(s, vertree, self._inputs(s, arrays), path)
        return self._link(s, vertree, array, age, [path], "MERGE_WORK_FINISHED", replaces=arrays)

    def _count_discards(self, s: dict, vertree: int, before: DataFrame, path: str) -> None:
        """Add up what a merge dropped of deleted versions and by user timestamps; a row a version comes back."""
        tree, timestamped = self._tree(s, vertree), s["vertrees"][str(vertree)]["timestamped"]
        if not timestamped and not any(x.deleted for x in tree.versions.values()):
            return  # nothing can have gone
        entries = resolve.newest(before.select("dims", "v", "seq", "uts", "op"), ["dims", "v"], timestamped)
        after = self.spark.read.schema(STORED).parquet(path)
        for r in stats.discard_stats(entries, after, ["dims"], tree.frame(self.spark), timestamped).collect():
            was = s["discards"].get(str(r["v"]), [0, 0])
            s["discards"][str(r["v"])] = [was[0] + r["version_deletes"], was[1] + r["timestamp_rejects"]]

    def merge_start(self, vertree: int, arrays: list[int]) -> int:
        """Begin a merge that goes on by ``merge_work``; its inputs stay readable, and no other merge may take them."""
        s = self.state()
        self._check_merge(s, vertree, arrays)
        merge, array = self._id(s), self._id(s)
        for a in arrays:
            s["arrays"][str(a)]["state"] = "input"
        total = sum(s["arrays"][str(a)]["items"] for a in arrays)
        s.setdefault("merges", {})[str(merge)] = {"id": merge, "vertree": vertree, "arrays": arrays, "output": array, "units": 0, "done": 0, "total": total, "paths": []}
        self._change(s, "MERGE_STARTED", vertree, merge)
        return merge

    def merge_work(self, merge: int, units: int = MERGE_UNITS) -> bool:
        """Merge the keys of the next units; True once the output has taken the place of the inputs.

        A unit is a part of all keys by their hash. A call that fails leaves no
        trace but a folder that no catalogue names, and may be made again.
        """
        s = self.state()
        m = s.get("merges", {}).get(str(merge))
        if m is None:
            raise StoreError(112)
        if units < 1:
            raise StoreError("EINVAL", "no units")
        age = min(s["arrays"][str(a)]["data_age"] for a in m["arrays"])
        span = (m["units"], min(m["units"] + units, MERGE_UNITS))
        m["paths"].append(self._write_run(m["vertree"], m["output"], self._merged(s, m["vertree"], m["arrays"], m["output"], age, span)))
        self._count_discards(s, m["vertree"], self._inputs(s, m["arrays"], span), m["paths"][-1])
        m["units"], m["done"] = span[1], m["done"] + self._inputs(s, m["arrays"], span).count()
        if m["units"] < MERGE_UNITS:
            self._change(s, "MERGE_WORK_DONE", m["vertree"], merge)
            return False
        del s["merges"][str(merge)]
        self._link(s, m["vertree"], m["output"], age, m["paths"], "MERGE_WORK_FINISHED", replaces=m["arrays"])
        return True

    # incremental backup

    def backup_start(self, vertree: int) -> int:
        s = self.state()
        self._tree(s, vertree)
        meta = s["vertrees"][str(vertree)]
        if meta["pending_barrier"] is not None:
            raise StoreError("EBUSY", "a backup is running")
        array = self._id(s)
        s["arrays"][str(array)] = {"id": array, "vertree": vertree, "data_age": array, "level": 2, "paths": [], "items": 0, "bytes": 0, "min_uts": None, "max_uts": None, "barrier": True, "state": "barrier"}
        meta["pending_barrier"] = array
        self._change(s, "BACKUP_STARTED", vertree, array)
        return array

    def backup_rows(self, vertree: int) -> DataFrame:
        """What has come since the last backup that succeeded, tombstones included."""
        s = self.state()
        meta = s["vertrees"][str(vertree)]
        if meta["pending_barrier"] is None:
            raise StoreError("EINVAL", "no backup is running")
        age = lambda k: s["arrays"][str(k)]["data_age"]
        return stats.backup_rows(self.log(vertree, s), age(meta["barrier"]) if meta["barrier"] is not None else -1, age(meta["pending_barrier"]))

    def backup_finish(self, vertree: int, succeeded: bool = True) -> None:
        s = self.state()
        meta = s["vertrees"][str(vertree)]
        if meta["pending_barrier"] is None:
            raise StoreError("EINVAL", "no backup is running")
        gone = meta["barrier"] if succeeded else meta["pending_barrier"]
        if succeeded:
            meta["barrier"] = meta["pending_barrier"]
        if gone is not None:
            del s["arrays"][str(gone)]
        meta["pending_barrier"] = None
        self._change(s, "BACKUP_FINISHED" if succeeded else "BACKUP_FAILED", vertree)

    # views

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def arrays(self, state: dict | None = None) -> DataFrame:
        s = state or self.state()
        rows = [(a["vertree"], a["id"], a["level"], a["data_age"], a["items"], a["bytes"], a["min_uts"], a["max_uts"], a["barrier"], a["state"]) for a in s["arrays"].values()]
        return self._rows(rows, "vertree long, array_id long, level int, data_age long, item_count long, nr_bytes long, min_user_ts long, max_user_ts long, is_barrier boolean, merge_state string")

    def versions(self, vertree: int) -> DataFrame:
        """Versions with their place in the tree, what merging their entries would count, and what merges have dropped."""
        s = self.state()
        counted = stats.version_stats(self.log(vertree, s), ["dims"], s["vertrees"][str(vertree)]["timestamped"])
        dropped = self._rows([(int(v), *n) for v, n in s["discards"].items()], "v long, version_deletes long, timestamp_rejects long")
        out = self._tree(s, vertree).frame(self.spark).withColumn("vertree", F.lit(vertree).cast("long")).join(counted, "v", "left").join(F.broadcast(dropped), "v", "left")
        return out.na.fill(0, ["keys", "tombstones", "tombstone_deletes", "key_replaces", "version_deletes", "timestamp_rejects"])

    def vertrees(self) -> DataFrame:
        s = self.state()
        rows = []
        for k, t in s["vertrees"].items():
            own = [a for a in s["arrays"].values() if a["vertree"] == int(k) and not a["barrier"]]
            rows.append((int(k), t["root"], t["timestamped"], t["discard_s"], len(own), sum(a["items"] for a in own), sum(a["bytes"] for a in own), t["barrier"]))
        return self._rows(rows, "vertree long, root_version long, timestamped boolean, discard_s long, arrays int, item_count long, nr_bytes long, active_barrier long")

    def merges(self) -> DataFrame:
        """Merges under way: inputs, output, and how many of the inputs' entries are through."""
        rows = [(m["id"], m["vertree"], m["arrays"], m["output"], m["done"], m["total"], 100 * m["done"] // max(m["total"], 1)) for m in self.state().get("merges", {}).values()]
        return self._rows(rows, "merge_id long, vertree long, in_arrays array<long>, out_array long, done long, total long, percent long")

    def collections(self) -> DataFrame:
        """Collections, with the requests made to each since it was attached.

        Counts outlive a process from its next change or ``save_requests`` on. What
        reads return is not counted, as they are DataFrames that may never run.
        """
        s = self.state()
        asked = self._asked(s)
        rows = [(c["id"], n, c["vertree"], c["version"], c["read_only"], *(asked.get(str(c["id"]), {}).get(k, 0) for k in REQUESTS)) for n, c in s["collections"].items()]
        return self._rows(rows, "collection_id long, name string, vertree long, version long, read_only boolean, " + ", ".join(f"{k} long" for k in REQUESTS))

    def events(self) -> DataFrame:
        """(event_id, ts, cmd, args) of all changes."""
        self._publish_event(self.state())
        return self.spark.read.schema(EVENTS).json(f"{self.root}/events")

    def event_stream(self, max_files: int = 1000) -> DataFrame:
        """The events as a stream: those so far, then each change as it is made."""
        self._publish_event(self.state())
        return self.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).json(f"{self.root}/events")
