"""WARC archives of pages, read back into globally ordered capture histories.

1. Payload digests are grouped (map-side first) to find, for equal payloads of at least ``least``
   bytes, the capture with the largest id: its record is the response, the others revisit it.
2. Tasks write gzip-member archives straight into the shared folder, each under its final name only
   when it is whole, so a retried task replaces its own file.
3. Archives are read back, payload digests are verified, and each archive's index entries are sorted by
   (URL key, timestamp, id) into a run, one file of blocks in the shared folder. Its first keys make a small table.
4. While there are more than ``fan_in`` runs, tasks merge groups of them into longer ones. The last merge is cut into key ranges, with
   bounds from the blocks' first keys; each range's task opens the runs and merges their slices by a loser tree, holding one block
   of each. The key is unique, so one URL that holds a third of all captures spans many ranges.
5. A URL's captures are numbered in each range; what earlier ranges have of a range's first URL is added, from one row a range.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, filesystem, publish, small_batches, table

LEAST = 1000
ROLL_BYTES = 256 << 20
FAN_IN = 64
BLOCK = 4096  # entries of a run's block
_KEY = "url_key string, ts long, known boolean, page_id long, archive string, offset long"
INDEX = "run string, block int, first struct<" + _KEY.replace(" ", ":").replace(",:", ",") + ">, next struct<" + _KEY.replace(" ", ":").replace(",:", ",") + ">"
RUN = "url_key string, ts long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
HISTORY = RUN + ", position long, capture long"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the right, then port, path and query; no scheme, ``www.`` or fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip().lower())
        host, port = u.hostname or "", f":{u.port}" if u.port else ""
    except ValueError:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + port + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def _stamp(seconds: int) -> str:
    import datetime

    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _seconds(stamp: str) -> int:
    import datetime

    return int((datetime.datetime.strptime(stamp, "%Y-%m-%dT%H:%M:%SZ") - datetime.datetime(1970, 1, 1)).total_seconds())


def record(page_id, url, payload: bytes, digest: str, refers_to, ts: int) -> bytes:
    """One WARC/1.1 record. URL and id headers are percent-encoded where needed."""
    from urllib.parse import quote

    rev = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if rev else b"Content-Length: %d\r\n" % len(payload)) + b"\r\n"
    block = http + (b"" if rev else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if rev else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_stamp(ts)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    if rev:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream, chunk: int = 1 << 20):
    """(offset, bytes) of each gzip member; memory holds one member and one chunk."""
    at, start, d, parts, data = 0, 0, zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                if parts:
                    raise ValueError("an archive is cut off")
                return
        n = len(data)
        parts.append(d.decompress(data))
        data = d.unused_data
        at += n - len(data)
        if d.eof:
            yield start, b"".join(parts)
            start, d, parts = at, zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple[dict, bytes]:
    """Headers (lower-case names) and payload, of which the digest is verified for responses."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode().split("\r\n")[1:])}
    block = rest[: int(head["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if head["warc-type"] == "response" and "sha1:" + hashlib.sha1(payload).hexdigest() != head["warc-payload-digest"]:
        raise ValueError(f"payload digest of {head['warc-record-id']} differs")
    return head, payload


def loser_tree(runs: list):
    """Merge sorted iterators. Inner nodes keep the loser of their match, so a new head of one run is
    played against the log2(k) losers on its own path only."""
    done = (1,)
    heads = []
    runs = [iter(r) for r in runs]

    def pull(i):
        x = next(runs[i], done)
        return done if x is done else (0, x)

    k = len(runs)
    if not k:
        return
    heads = [pull(i) for i in range(k)]
    tree = [0] * k

    def play(node):
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if (heads[b], b) < (heads[a], a):
            a, b = b, a
        tree[node] = b
        return a

    winner = play(1) if k > 1 else 0
    while heads[winner] is not done:
        yield heads[winner][1]
        heads[winner] = pull(winner)
        node = (winner + k) // 2
        while node:
            other = tree[node]
            if (heads[other], other) < (heads[winner], winner):
                tree[node], winner = winner, other
            node //= 2


def write_archives(pages: DataFrame, scratch: Scratch, least: int = LEAST, level: int = 1, epoch: int = 1_600_000_000) -> DataFrame:
    """Write the archives; a table (archive, records) of what was written. ``pages``: page_id, url, html, ts."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.col("ts").cast("long").alias("ts"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("n"), F.xxhash64(html).alias("check"))
    groups = rows.where(F.col("n") >= least).groupBy("digest", "n", "check").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND first IS NOT NULL")
    groups = scratch.table(groups.drop("copies"), "groups")
    marked = rows.join(groups, ["digest", "n", "check"], "left").select("page_id", "url", "html", "ts", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))
    folder = scratch.path("archives")
    small_batches(pages.sparkSession, 500)

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, number, done = TaskContext.get().partitionId(), 0, []
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        row = next(rows, None)
        while row is not None:
            path, count = f"{folder}/part-{task:06d}-{number:03d}.warc.gz", 0

            def fill(out):
                nonlocal row, count
                size = 0
                while row is not None and size < ROLL_BYTES:
                    page, url, text, ts, digest, refers = row
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = z.compress(record(page, url, text.encode(), digest, refers, ts)) + z.flush()
                    out.write(data)
                    size += len(data)
                    count += 1
                    row = next(rows, None)

            publish(path, fill)
            done.append((path, count))
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["archive", "records"])

    return scratch.table(marked.mapInArrow(work, "archive string, records long"), "written")


def entry_key(r: tuple) -> tuple:
    """What entries sort by: URL key, time, id (null first), place."""
    return r[0], r[1], r[2] is not None, r[2] or 0, r[7], r[8]


def _schema(ddl: str):
    import pyarrow as pa

    return pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in ddl.split(", "))])


def write_run(path: str, entries, block: int) -> list[tuple]:
    """Write sorted ``entries`` as a run; (run, block, first key, next block's first key) of its blocks. Memory holds one block."""
    import pyarrow as pa

    firsts, schema = [], _schema(RUN)

    def fill(out):
        firsts.clear()
        with pa.ipc.new_file(out, schema) as sink:
            held = []

            def flush():
                firsts.append(entry_key(held[0]))
                sink.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema))
                held.clear()

            for r in entries:
                held.append(r)
                if len(held) == block:
                    flush()
            if held:
                flush()

    publish(path, fill)
    return [(path, k, first, firsts[k + 1] if k + 1 < len(firsts) else None) for k, first in enumerate(firsts)]


def read_run(path: str, blocks, low: tuple | None = None, high: tuple | None = None):
    """(key, entry) of the run's ``blocks`` from ``low`` on and below ``high``."""
    import pyarrow as pa

    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        source = pa.ipc.open_file(f)
        for k in blocks:
            for r in zip(*(c.to_pylist() for c in source.get_batch(k).columns)):
                key = entry_key(r)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield key, r


def _index_batch(rows: list):
    import pyarrow as pa

    key = pa.struct([("url_key", pa.string()), ("ts", pa.int64()), ("known", pa.bool_()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])
    names = [f.name for f in key]
    wide = lambda x: None if x is None else dict(zip(names, x))
    columns = [[r[0] for r in rows], [r[1] for r in rows], [wide(r[2]) for r in rows], [wide(r[3]) for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), key, key))], names=["run", "block", "first", "next"])


def read_archives(archives: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Sort each archive's index entries into a run; the blocks of all runs (INDEX)."""
    folder = scratch.path("runs-0")

    def work(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, p = filesystem(path)
                name, run = p.rpartition("/")[2], []
                with fs.open_input_stream(p, compression=None) as stream:
                    for offset, raw in members(stream):
                        head, _ = parse(raw)
                        ident = head["warc-record-id"].removeprefix("<urn:page:").rstrip(">")
                        refers = head.get("warc-refers-to", "").removeprefix("<urn:page:").rstrip(">")
                        run.append((url_key(head.get("warc-target-uri")), _seconds(head["warc-date"]), int(ident) if ident else None, int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], int(refers) if refers else None, name, offset))
                run.sort(key=entry_key)
                yield _index_batch(write_run(f"{folder}/{name}.run", run, block))

    files = archives.select("archive").repartition(max(1, archives.count()), "archive")
    return scratch.table(files.mapInArrow(work, INDEX), "index-0")


def merge_passes(index: DataFrame, scratch: Scratch, fan_in: int, block: int) -> DataFrame:
    """The blocks of at most about ``fan_in`` runs: groups of runs are merged until there are no more."""
    k = 0
    while (n := index.select("run").distinct().count()) > fan_in:
        k, groups = k + 1, -(-n // fan_in)
        folder = scratch.path(f"runs-{k}")

        def work(batches, folder=folder):
            from pyspark import TaskContext

            runs = [r for b in batches for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            if runs:
                merged = loser_tree([read_run(path, range(blocks)) for path, blocks in sorted(runs)])
                yield _index_batch(write_run(f"{folder}/{TaskContext.get().partitionId():06d}.run", (r for _, r in merged), block))

        runs = index.groupBy("run").agg(F.count(F.lit(1)).alias("blocks")).select(F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int").alias("p"), "run", "blocks")
        index = scratch.table(runs.repartitionById(groups, F.col("p")).mapInArrow(work, INDEX), f"index-{k}")
    return index


def merge_runs(index: DataFrame, scratch: Scratch, fan_in: int = FAN_IN, block: int = BLOCK) -> DataFrame:
    """Runs merged into global order: ``position`` orders all captures, ``capture`` numbers those of one URL key. Partitions come in key order."""
    spark = index.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = merge_passes(index, scratch, fan_in, block)
    dealt = index.select("first").repartitionByRange(parts, "first").groupBy(F.spark_partition_id().alias("p")).agg(F.min("first").alias("low"))
    bounds = sorted(tuple(r["low"]) for r in dealt.collect())  # a row a partition

    def ranges(batches):
        import bisect

        import pyarrow as pa

        for b in batches:
            out = []
            for run, k, first, after in zip(*(c.to_pylist() for c in b.columns)):
                first, after = tuple(first.values()), tuple(after.values()) if after else None
                last = len(bounds) if after is None else max(bisect.bisect_left(bounds, after), 1)
                out += [(r, run, k) for r in range(max(bisect.bisect_right(bounds, first) - 1, 0), last)]
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32()))], names=["p", "run", "block"])

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        blocks: dict[str, list[int]] = {}
        part = TaskContext.get().partitionId()
        for b in batches:
            for run, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                blocks.setdefault(run, []).append(k)
        low, high = (bounds[part] if part < len(bounds) else None), (bounds[part + 1] if part + 1 < len(bounds) else None)
        position, last, capture, out, schema = part << 33, None, 0, [], _schema(HISTORY)
        for _, r in loser_tree([read_run(run, sorted(ks), low, high) for run, ks in sorted(blocks.items())]):
            capture = capture + 1 if r[0] == last else 0
            last = r[0]
            out.append((*r, position, capture))
            position += 1
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    if not bounds:
        return spark.createDataFrame([], HISTORY)
    slices = index.mapInArrow(ranges, "p int, run string, block int").repartitionById(len(bounds), F.col("p"))
    merged = scratch.table(slices.mapInArrow(work, HISTORY), "merged")
    ends = merged.groupBy(F.shiftright("position", 33).alias("p")).agg(F.min("url_key").alias("first_key"), F.max("url_key").alias("last_key"), F.max(F.struct("position", "capture")).alias("end"))
    before, carried = [], None
    for r in sorted(ends.collect()):  # a row a range
        start = carried[1] if carried and carried[0] == r["first_key"] else 0
        before.append((r["p"], r["first_key"], start))
        carried = (r["last_key"], r["end"]["capture"] + 1 + (start if r["first_key"] == r["last_key"] else 0))
    starts = F.broadcast(spark.createDataFrame(before, "p long, first_key string, start long"))
    numbered = merged.join(starts, (F.shiftright("position", 33) == starts["p"]) & (merged["url_key"] == starts["first_key"]), "left")
    return numbered.select(*[c.split()[0] for c in RUN.split(", ")], "position", (F.col("capture") + F.coalesce("start", F.lit(0))).alias("capture"))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts_col: str | None = None, epoch: int = 1_600_000_000, fan_in: int = FAN_IN, block: int = BLOCK) -> DataFrame:
    """Write ``pages`` as WARC archives, read them back and return the merged capture history.

    A null html is an empty payload; a null URL has no target header and the empty key; null ids make
    responses, and never the response that others refer to. Without ``ts_col`` a capture's time is
    ``epoch`` + its id (0 for null, folded to ten years). Rows that repeat an id and payload are all
    responses if that id is the largest of the group, else all revisits. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    ts = F.coalesce(F.col(ts_col).cast("long"), F.lit(epoch)) if ts_col else F.lit(epoch) + F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(315_360_000))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), ts.alias("ts"))
    archives = write_archives(rows, scratch)
    return merge_runs(read_archives(archives, scratch, block), scratch, fan_in, block)


def op9_warc(spark, sf_dir):
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS first FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON g.h = p.h
"""
