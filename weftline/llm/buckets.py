"""Pairs of items that share a key, for operators that hash items into buckets and verify pairs.

Keys travel in packed blocks, one row for thousands of (key, item), and meet in sorted arrays. What a task holds is its
share of the blocks. A key with many members in one task's block sends all but a few of them past the sort, evenly dealt, and
is a large bucket by that; so no key gathers in one task.

A bucket of at most ``ALL`` members gives all its pairs, those with its leader, the item of least hash, first. In one of at most
``most`` members each item that fits no leader before it becomes a leader, and the others pair with the first leader they
fit. Members of a still larger one pair with its leader, and those that links do not connect to it with a second one. That joins
groups of copies by few pairs. Then all pairs of its members that are not connected yet meet in squares of blocks (``crossed``), and those
that ``fits`` and ``may`` do not rule out are verified there, so no pair is lost in a bucket of any size, and what leaves a square are the
links that connect its members, fewer than these. Squares are dealt in turns, as each sends copies of its members' data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, claim
from .words import mix

ALL = 16
_ORDERS = 2  # orders by which buckets choose their leaders
_HOLD = 500_000  # (key, item) rows that a task sorts at once
_SLICE = 500_000  # pairs that are made at once
_BLOCK = 512  # members of a large bucket in a side of a square, where that makes at most _COPIES blocks; up to four times as many else
_COPIES = 16
_RULED = 20_000  # pairs that ``may`` sees at once
_SENT = 0.5  # copies of a member, on average, that are shuffled at once
_SLICES = 4  # in which members get their data
FOUND = "a long, b long, star boolean, sure boolean, key long, at int, size int, sig int, pos int"
_MEMBER = ["key", "at", "id", "size", "sig", "pos"]
_TYPES = (("key", "<u8"), ("id", "<i8"), ("size", "<u4"), ("sig", "<u4"), ("pos", "<u4"), ("at", "u1"))


def pack(rows: dict[str, np.ndarray]) -> bytes:
    """Columns by byte planes, which compress well where high bytes are alike."""
    return b"".join(np.ascontiguousarray(rows[c].astype(t, copy=False).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T).tobytes() for c, t in _TYPES)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    n, at, out = len(data) // sum(np.dtype(t).itemsize for _, t in _TYPES), 0, {}
    for c, t in _TYPES:
        width = np.dtype(t).itemsize
        out[c] = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(t).ravel()
        at += n * width
    return out


def _take(rows: dict, at) -> dict:
    return {c: x[at] for c, x in rows.items()}


def _runs(rows: dict) -> tuple[dict, np.ndarray, np.ndarray]:
    """Sorted by key, and the runs' starts and lengths."""
    rows = _take(rows, np.argsort(rows["key"]))
    k = rows["key"]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return rows, starts, np.diff(np.r_[starts, len(k)])


def always(x: dict, y: dict) -> np.ndarray:
    return np.ones(max(len(x["key"]), len(y["key"])), bool)


def meet(rows: DataFrame, read: Callable, fits: Callable, scratch: Scratch, name: str, most: int = ALL, sure: Callable = always, part: int = 0, parts_of: int = 1) -> tuple[DataFrame, DataFrame]:
    """(a, b, star, sure, key) pairs of buckets of at most ``most`` members, a < b, star if with a leader, and members (_MEMBER) of larger ones,
    both with repetitions where rows repeat.

    ``read`` makes the columns of _TYPES from an Arrow batch of ``rows``; ``fits`` says of two such sets of columns
    which pairs may be linked at all, ``sure`` which of these need no second key. Keys whose ``at`` leaves ``part`` when divided by ``parts_of`` are taken.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def deal(batches):
        import pyarrow as pa

        claim("lines")
        held, n, turn = [], 0, 0

        def blocks():
            nonlocal turn
            found, starts, sizes = _runs({c: np.concatenate([x[c] for x in held]) for c, _ in _TYPES})
            place = np.arange(len(found["key"])) - np.repeat(starts, sizes)
            past = place > most + 48
            owner = ((found["key"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            kept = np.flatnonzero(~past)
            cuts = np.searchsorted(owner[kept], np.arange(parts + 1))
            out = [(p, False, pack(_take(found, kept[cuts[p] : cuts[p + 1]]))) for p in range(parts) if cuts[p] < cuts[p + 1]]
            rest = np.flatnonzero(past)
            for at in range(0, len(rest), 4096):
                turn += 1
                out.append((int(mix(np.array([turn * 7919 + len(found["key"])], np.uint64))[0] % np.uint64(parts)), True, pack(_take(found, rest[at : at + 4096]))))
            p, hot, data = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(hot, pa.bool_()), pa.array(data, pa.binary())], names=["p", "hot", "data"])

        for b in batches:
            x = read(b)
            if parts_of > 1:
                x = _take(x, x["at"] % parts_of == part)
            x["key"] = mix(x["key"])
            held.append(x)
            n += len(x["key"])
            if n >= _HOLD:
                yield blocks()
                held, n = [], 0
        if n:
            yield blocks()

    def pairs(batches):
        import pyarrow as pa

        claim("lines")
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        names = [c.split()[0] for c in FOUND.split(", ")]

        def batch(n, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds)], names=names)

        def members(x):
            for at in range(0, len(x["key"]), 100_000):
                y = _take(x, slice(at, at + 100_000))
                yield batch(len(y["key"]), a=y["id"], key=y["key"].view(np.int64), at=y["at"].astype(np.int32), size=y["size"].view(np.int32), sig=y["sig"].view(np.int32), pos=y["pos"].view(np.int32))

        def stars(found):
            a, b, close, key = (np.concatenate(x) for x in zip(*found))
            return batch(len(a), a=np.minimum(a, b), b=np.maximum(a, b), star=np.ones(len(a), bool), sure=close, key=key.view(np.int64))

        held = []
        for b in batches:
            for hot, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if hot:
                    yield from members(unpack(data))
                else:
                    held.append(unpack(data))
        if not held:
            return
        rows, starts, sizes = _runs({c: np.concatenate([x[c] for x in held]) for c, _ in _TYPES})
        held.clear()
        large = sizes > most
        yield from members(_take(rows, np.flatnonzero(np.repeat(large, sizes))))
        for size in range(2, ALL + 1):
            found = starts[sizes == size]
            step = max(1, _SLICE // (size * (size - 1) // 2))
            i, j = np.triu_indices(size, 1)
            for at in range(0, len(found), step):
                at = found[at : at + step, None] + np.arange(size)
                at = np.take_along_axis(at, np.argsort(mix(rows["id"][at].view(np.uint64)), 1), 1)  # the leader first
                x, y, star = at[:, i].ravel(), at[:, j].ravel(), np.tile(i == 0, len(at))
                keep = (rows["id"][x] != rows["id"][y]) & fits(_take(rows, x), _take(rows, y))
                x, y = _take(rows, x[keep]), _take(rows, y[keep])
                yield batch(len(x["id"]), a=np.minimum(x["id"], y["id"]), b=np.maximum(x["id"], y["id"]), star=star[keep], sure=sure(x, y), key=x["key"].view(np.int64))
        out, n = [], 0
        for start, size in zip(starts[(sizes > ALL) & ~large].tolist(), sizes[(sizes > ALL) & ~large].tolist()):
            own = _take(rows, slice(start, start + size))
            own = _take(own, np.argsort(mix(own["id"].view(np.uint64) + np.uint64(own["at"].min() % _ORDERS) * np.uint64(0x9E3779B97F4A7C15))))
            free = np.ones(size, bool)
            for i in range(size - 1):
                if free[i]:
                    after = np.flatnonzero(free[i + 1 :]) + i + 1
                    after = after[fits(_take(own, slice(i, i + 1)), _take(own, after))]
                    free[after] = False
                    after = after[own["id"][after] != own["id"][i]]
                    if len(after):
                        x, y = _take(own, np.full(len(after), i)), _take(own, after)
                        out.append((x["id"], y["id"], sure(x, y), x["key"]))
                        n += len(after)
            if n > 100_000:
                yield stars(out)
                out, n = [], 0
        if out:
            yield stars(out)

    blocked = rows.mapInArrow(deal, "p int, hot boolean, data binary").repartitionById(parts, F.col("p"))
    found = scratch.table(blocked.mapInArrow(pairs, FOUND), name)
    return found.where("b IS NOT NULL").select("a", "b", "star", "sure", "key"), found.where("b IS NULL").withColumnRenamed("a", "id").select(_MEMBER)


def read_members(b) -> dict[str, np.ndarray]:
    """Columns of a batch of members."""
    get = lambda c, t: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(t)
    return {"key": get("key", np.int64).view(np.uint64), "id": get("id", np.int64), "size": get("size", np.uint32), "sig": get("sig", np.int32).view(np.uint32), "pos": get("pos", np.int32).view(np.uint32), "at": get("at", np.uint8)}


_FEW = 200_000  # rows of ids that are broadcast; more are shuffled


def only(rows: DataFrame, ids: DataFrame, most: int = _FEW) -> DataFrame:
    """``rows`` whose id is among ``ids`` (id, no repeats); at most ``most`` ids are broadcast, more are shuffled."""
    return rows.join(F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids, "id", "left_semi")


def opened(members: DataFrame, scratch: Scratch) -> DataFrame:
    """id, root, m: the keys of ``members`` (_MEMBER, root; no repeats) that items of different roots share, with the number of blocks of each."""
    n = F.count(F.lit(1))
    blocks = F.greatest(F.ceil(n / (4 * _BLOCK)), F.least(F.ceil(n / _BLOCK), F.lit(_COPIES))).cast("int").alias("blocks")
    keys = scratch.table(members.groupBy("key").agg(blocks, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "blocks"), "keys")
    rows = members.join(F.broadcast(keys) if keys.limit(_FEW + 1).count() <= _FEW else keys, "key")
    return rows.groupBy("id", "root").agg(F.collect_list(F.struct("key", "at", "size", "sig", "pos", "blocks")).alias("m"))  # at most an item's keys


def turns(members: DataFrame) -> int:
    """In how many turns the squares of ``members`` (see ``opened``) are dealt, so that a turn's shuffle holds ``_SENT`` copies of a member on average."""
    copies = F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + x["blocks"])
    found = members.agg(F.sum(copies).alias("copies"), F.count(F.lit(1)).alias("n")).first()
    return max(1, math.ceil((found["copies"] or 0) / (_SENT * max(1, found["n"]))))


def crossed(members: DataFrame, extra: DataFrame, payload: DataFrame, fits: Callable, may: Callable, judge: Callable, scratch: Scratch | None = None, spent: tuple = ()) -> DataFrame:
    """(a, b): links of ``members`` (see ``opened``) that share a key, enough of them to connect, with the roots, what links of such items connect.
    ``extra``: id, level, extra (binary of one width), which ``may`` gets besides; ``payload``: id, data, which ``judge`` gets.

    A key's members are cut into blocks; each two blocks make a square, which one task has at once. A pair is verified at the least key it
    shares, unless ``fits`` or ``may`` rule it out or links of the square connect it. With ``scratch`` members with their data, then
    each turn's links are written there, and the tables ``spent``, which the former were made of, are deleted.
    """
    if scratch is None:
        return squares(members.join(payload, "id").join(extra, "id"), fits, may, judge)
    n, slices = turns(members), [f"whole-{k}" for k in range(_SLICES)]
    for k, name in enumerate(slices):
        own = [x.where(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(_SLICES)) == k) for x in (members, payload, extra)]
        made = scratch.table(own[0].join(own[1], "id").join(own[2], "id"), name, "zstd")
    whole = scratch.spark.read.schema(made.schema).parquet(*map(scratch.path, slices))
    scratch.drop(*spent)
    names = [f"crossed-{turn}" for turn in range(n)]
    for turn, name in enumerate(names):
        scratch.table(squares(whole, fits, may, judge, turn, n), name)
    scratch.drop(*slices)
    return scratch.spark.read.schema("a long, b long").parquet(*map(scratch.path, names))


def squares(whole: DataFrame, fits: Callable, may: Callable, judge: Callable, turn: int = 0, turns_of: int = 1) -> DataFrame:
    """What ``crossed`` finds in the squares of one turn. ``whole``: its members with data and extra."""
    parts = max(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = whole.withColumn("keys", F.col("m.key")).withColumn("m", F.explode("m")).where("m.at div 32 = level")
    rows = rows.select("id", "root", "keys", "data", "extra", "m.*").withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root", "size", "sig", "pos", "extra", "keys", "data")
    rows = rows.where(F.pmod(F.xxhash64("key", "i", "j", F.lit(11)), F.lit(turns_of)) == turn)

    def linked(x: dict) -> list[tuple[int, int]]:
        n, key, out = len(x["id"]), int(x["key"][0]), []
        square, numbers = x["i"][0] != x["j"][0], ("id", "size", "sig", "pos", "extra")
        label = np.unique(x["root"], return_inverse=True)[1]
        keys, data, ids = [set(k) for k in x["keys"]], x["data"], x["id"].tolist()
        step = max(1, _SLICE // n)
        for at in range(0, n, step):
            left = slice(at, at + step)
            open_ = label[left, None] != label[None, :]
            open_ &= (x["own"][left, None] == x["i"][0]) & (x["own"][None, :] == x["j"][0]) if square else np.arange(n)[left, None] < np.arange(n)[None, :]
            i, j = np.nonzero(open_)
            i += at
            keep = fits({c: x[c][i] for c in numbers[:-1]}, {c: x[c][j] for c in numbers[:-1]})
            i, j = i[keep], j[keep]
            for k in range(0, len(i), _RULED):
                a, b = i[k : k + _RULED], j[k : k + _RULED]
                still = label[a] != label[b]
                a, b = a[still], b[still]
                keep = may({c: x[c][a] for c in numbers}, {c: x[c][b] for c in numbers})
                for p, q in zip(a[keep].tolist(), b[keep].tolist()):
                    if label[p] != label[q] and min(keys[p] & keys[q]) == key and judge(data[p], data[q]):
                        label[label == label[q]] = label[p]
                        out.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
        return out

    def work(batches):
        import pyarrow as pa

        claim("lines")

        def out(held):
            found = linked({c: np.concatenate([y[c] for y in held]) for c in held[0]})
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def objects(values):
            made = np.empty(len(values), object)
            made[:] = values
            return made

        held: list[dict] = []
        for b in batches:
            if not len(b):
                continue
            column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            x = {c: column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "own", "id", "root", "size", "sig", "pos")}
            x |= {c: x[c].view(np.uint32) for c in ("size", "sig", "pos")}
            x["extra"] = np.frombuffer(b"".join(column("extra").to_pylist()), np.uint8).reshape(len(b), -1)
            x["data"] = objects(column("data").to_pylist())
            x["keys"] = objects([tuple(k) for k in column("keys").to_pylist()])
            ends = np.flatnonzero((x["key"][1:] != x["key"][:-1]) | (x["i"][1:] != x["i"][:-1]) | (x["j"][1:] != x["j"][:-1])) + 1
            if held and any(held[0][c][0] != x[c][0] for c in ("key", "i", "j")):
                ends = np.r_[0, ends]
            cuts = np.r_[0, ends, len(b)]
            for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                if k:  # what is held is whole
                    yield from out(held)
                    held = []
                if lo < hi:
                    held.append(_take(x, slice(lo, hi)))
        if held:
            yield from out(held)

    return rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "id").mapInArrow(work, "a long, b long")


def links(rows: DataFrame, read: Callable, fits: Callable, near: str, extra_of: Callable, may: Callable, payload_of: Callable, judge: Callable, scratch: Scratch, most: int = ALL, sure: Callable = always, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """Linked (a, b) pairs of items that share a key, enough of them to connect what links between such items connect, and (node, root) of their components.

    ``rows``, ``read``, ``fits``, ``most``, ``sure``: see ``meet``; pairs that are not sure need two keys in common. ``near``: the same as ``fits`` in SQL, of columns and such that start with lead_;
    ``extra_of``, ``may``: see ``crossed``, ``extra_of`` from ids (id); ``at`` is level * 32 + the key's place in the item;
    ``payload_of``: table of ids to (id, data), what is compared; ``judge``: whether two data are linked. Keys meet in ``rounds`` by their place,
    so that a shuffle holds a part of them.
    """
    known: list[DataFrame] = []

    def work(batches):
        import pyarrow as pa

        claim("lines")
        for b in batches:
            linked = [judge(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    def verified(pairs: DataFrame, roots: DataFrame | None, name: str, members: DataFrame | None = None) -> DataFrame:
        """Roots after verifying distinct pairs, which become known, and those that ``members`` (see ``opened``) make."""
        k = len(known)
        pairs = pairs.select("a", "b").distinct()
        for x in known:
            pairs = pairs.join(x.select("a", "b"), ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, f"pairs-{k}")
        if roots is not None and members is None and pairs.isEmpty():
            return roots
        ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
        ends = scratch.table((ends if members is None else ends.unionByName(members.select("id"))).distinct(), f"ends-{k}")
        payload = scratch.table(payload_of(ends), f"payload-{k}", "zstd")
        known.append(scratch.table(dealt(pairs, payload).mapInArrow(work, "a long, b long, linked boolean"), f"verdicts-{k}"))
        new = known[-1].where("linked").select("a", "b")
        if members is not None:
            extra = scratch.table(extra_of(members.select("id")), "extra")
            known.append(crossed(members, extra, payload, fits, may, judge, scratch, (f"ends-{k}", f"payload-{k}", "extra", "opened")).withColumn("linked", F.lit(True)))
            new = new.unionByName(known[-1].select("a", "b"))
        scratch.drop(f"pairs-{k}", f"ends-{k}", f"payload-{k}", "extra")
        if roots is not None:
            new = new.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        return components(new, scratch, name)

    def edges() -> DataFrame:
        out = known[0]
        for x in known[1:]:
            out = out.unionByName(x)
        return out.where("linked").select("a", "b")

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs that links do not connect yet."""
        for end in "ab":
            pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
        return pairs.where("root_a IS NULL OR root_b IS NULL OR root_a <> root_b").drop("root_a", "root_b")

    def rooted(own: DataFrame, roots: DataFrame) -> DataFrame:
        """_MEMBER and root of the members (id, m) of large buckets."""
        r = roots.select(F.col("node").alias("id"), "root")
        return own.join(r, "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.explode("m").alias("m")).select("id", "root", "m.*").select(*_MEMBER, "root")

    def led(members: DataFrame, k: int) -> DataFrame:
        """Members that are not connected to their bucket's leader, with a, b (the pair with it) and near, whether the two may be linked."""
        leader = F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("draw"), *[F.col(c).alias(f"lead_{c}") for c in ("id", "size", "sig", "pos", "root")])).alias("l")
        out = members.join(members.groupBy("key").agg(leader).select("key", "l.*"), "key").where("root <> lead_root")
        return out.select(*_MEMBER, "root", F.least("id", "lead_id").alias("a"), F.greatest("id", "lead_id").alias("b"), F.expr(near).alias("near"))

    pairs, hot = meet(rows, read, fits, scratch, "met-0", most, sure, 0, rounds)
    for r in range(1, rounds):
        more = meet(rows, read, fits, scratch, f"met-{r}", most, sure, r, rounds)
        pairs, hot = pairs.unionByName(more[0]), hot.unionByName(more[1])
    pairs = pairs.groupBy("a", "b").agg(F.max("star").alias("star"), F.max("sure").alias("sure"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("sure OR lo <> hi")
    pairs = scratch.table(pairs.select("a", "b", "star"), "candidates")
    stars, own = pairs.where("star").select("a", "b"), None
    if not hot.isEmpty():
        own = scratch.table(hot.groupBy("id").agg(F.collect_set(F.struct(*[c for c in _MEMBER if c != "id"])).alias("m")), "hot")  # at most an item's keys
        alone = own.select("id", F.col("id").alias("root"), F.explode("m").alias("m")).select("id", "root", "m.*").select(*_MEMBER, "root")
        stars = stars.unionByName(led(alone, 0).where("near").select("a", "b"))
    scratch.drop(*[f"met-{r}" for r in range(rounds)])
    roots = verified(stars, None, "first")
    rest, members = pairs.where("NOT star").select("a", "b"), None
    if own is not None:
        second = led(led(rooted(own, roots), 0).select(*_MEMBER, "root"), 1)
        roots = verified(second.where("near").select("a", "b"), roots, "second")
        members = scratch.table(rooted(own, roots), "members")
        scratch.drop("hot")
        members = scratch.table(opened(members, scratch), "opened")
        scratch.drop("members", "keys")
    roots = verified(apart(rest, roots), roots, "rest", members)
    scratch.drop("candidates", "opened")
    return edges(), roots


def dealt(pairs: DataFrame, payload: DataFrame, portion: int = 64) -> DataFrame:
    """a, b, x, y: pairs with the ``payload`` (id, data) of both ends. An item of many pairs is dealt in portions
    of that many, each with its own copy of its payload, so that no item's pairs gather in one task."""
    for end, name in (("a", "x"), ("b", "y")):
        portions = pairs.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / portion).cast("int").alias("portions")).where("portions > 1")
        portions = F.broadcast(portions) if portions.limit(_FEW + 1).count() <= _FEW else portions
        own = payload.select(F.col("id").alias(end), F.col("data").alias(name))
        copies = own.join(portions, end).select(end, name, F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"))
        spread = pairs.join(portions, end, "left").withColumn("portion", F.coalesce(F.pmod(F.xxhash64("b", "a"), F.col("portions")).cast("int"), F.lit(-1))).drop("portions")
        pairs = spread.join(own.withColumn("portion", F.lit(-1)).unionByName(copies), [end, "portion"]).drop("portion")
    return pairs.select("a", "b", "x", "y")
