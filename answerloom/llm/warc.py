"""Web archives: deduplicated WARC files and a reader that salvages damaged ones."""

import base64
import re
import zlib
from functools import partial
from hashlib import sha1

from pyspark.sql import functions as F

from answerloom.session import ship_package

RECORD = "urn:x-page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def _digest(data):
    return "sha1:" + base64.b32encode(sha1(data).digest()).decode()


def record_bytes(page_id, url, payload, size, digest, refers_to, date):
    """One WARC record; a revisit carries the HTTP head of its payload and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: {_digest(block)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(date, batches):
    """A gzip member per row, without its last byte, which is the sink's line end (a zero)."""
    import pyarrow as pa

    from answerloom.llm.textscan import pieces

    for batch in batches:
        for part in pieces(batch, column=2, size=8_000_000):
            out = []
            for page_id, url, payload, size, digest, refers in zip(*(c.to_pylist() for c in part.columns)):
                data = record_bytes(page_id, url, (payload or "").encode(), size, digest, refers, date)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                if member[-1]:
                    # Only a record of 16 MiB or more ends so; an empty member closes it with a zero.
                    empty = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member += empty.compress(b"") + empty.flush()
                out.append(member[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_archives(pages, path, id_col="page_id", url_col="url", payload_col="html",
                   least=1000, per_file=2_000, date="2024-01-01T00:00:00Z"):
    """Write a record per row as gzip members of WARC files below ``path``.

    Of rows with equal payloads (UTF-8, NULL is empty) of at least ``least``
    bytes the one with the largest id is a response, the others are revisits
    that refer to it; smaller payloads are all responses. Rows with a NULL id
    are responses and never referred to; rows that repeat the largest id are
    responses as well. Other columns are ignored.

    Files go through Spark's text sink and its commit, so they can be on any store Spark
    writes to and a lost task leaves nothing behind. Payload groups meet in a
    max-aggregate over digests and in a join that Spark may split. A file holds at most
    ``per_file`` records.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    top = (
        rows.where(f"size >= {least} AND id IS NOT NULL").groupBy("digest")
        .agg(F.max("id").alias("top"), F.min("id").alias("low")).where("low < top").select("digest", "top")
    )
    refers = F.when(F.col("id") != F.col("top"), F.col("top"))
    rows = rows.join(top, "digest", "left").select(
        "id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "size", "digest", refers.alias("refers"))
    members = rows.mapInArrow(partial(_members, date), "member binary").select(F.col("member").cast("string"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


def _parse(data, at):
    """The record at ``at`` of uncompressed bytes and its end, or why there is none."""
    if not _START.match(data, at) or data[at:at + 2] == MEMBER[:2]:
        return None, "no version line"
    reach = 65_536
    while (stop := data.find(b"\r\n\r\n", at, at + reach)) < 0 and at + reach < len(data):
        if _START.search(data, at + 1, at + reach):
            break
        reach *= 2
    if stop < 0:
        return None, "unfinished header"
    if _START.search(data, at + 1, stop + 2):
        return None, "cut header"
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, "bad header line"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or not {"warc-type", "warc-record-id"} <= fields.keys():
        return None, "missing fields"
    begin = stop + 4
    end = begin + int(fields["content-length"])
    block = data[begin:end]
    if len(block) < end - begin:
        return None, "short block"
    if data[end:end + 4] != b"\r\n\r\n":
        return None, "no record end"
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and want != _digest(block):
        return None, "block digest"
    return (fields, block, end + 4), ""


def _inflate(data, at):
    """What the gzip member at ``at`` unpacks to as far as it does, the end of what was read, and what is wrong."""
    unpacker = zlib.decompressobj(31)
    try:
        plain = unpacker.decompress(memoryview(data)[at:])
        return plain, len(data) - len(unpacker.unused_data), "" if unpacker.eof else "short member"
    except zlib.error:
        pass
    unpacker, parts, step = zlib.decompressobj(31), [], 16_384
    while True:
        before = unpacker.copy()
        try:
            parts.append(unpacker.decompress(data[at:at + step]))
            at += step
        except zlib.error:
            if step == 1:
                return b"".join(parts), at + 1, "damaged member"
            unpacker, step = before, max(step // 16, 1)


def _inside(plain):
    """Valid records ``(fields, block, "")`` of unpacked bytes and gaps ``(None, None, why)`` between them."""
    i, lost, reason = 0, None, ""
    gap = lambda stop: (None, None, f"{reason}, unpacked bytes {lost} to {stop}")
    while i < len(plain):
        got, why = _parse(plain, i)
        if got:
            if lost is not None:
                yield gap(i)
                lost = None
            yield *got[:2], ""
            i = got[2]
            continue
        if lost is None:
            lost, reason = i, why
        following = _VERSION.search(plain, i + 1)
        i = following.start() if following else len(plain)
    if lost is not None:
        yield gap(len(plain))


def salvage(data):
    """All valid records of an archive, and the byte ranges between them that hold none.

    Yields ``(offset, length, fields, block, why)``; for a gap fields and block
    are None. A record is valid when its version line, header, length, end mark and
    block digest (if stated) are right. A member is unpacked as far as it goes
    and searched for records like plain bytes. Its records carry its byte range; a gap
    among them has length 0 and says in ``why`` which unpacked bytes it takes. A record
    without a block digest in a member that fails its own checks has that
    failure as ``why``. A member of one record that is cut is a gap. Where nothing valid is found, and after a member that
    fails, the search goes on at the next member or version line.
    """
    at, lost, reason = 0, None, ""
    # Records of a damaged member, which may lie open in its bytes up to ``read``.
    known, read = set(), 0
    key = lambda fields, block: (tuple(fields.items()), sha1(block).digest())
    while at < len(data):
        end, wrong = None, ""
        if data.startswith(MEMBER, at):
            plain, end, wrong = _inflate(data, at)
            rows = list(_inside(plain))
            if wrong == "short member" and len(rows) == 1:
                rows = []  # a member of one record, cut in its trailer
            why = wrong or next((w for _, _, w in rows if w), "").partition(",")[0]
            whole = not wrong and (not rows or any(f for f, _, _ in rows))
        else:
            got, why = _parse(data, at)
            rows, end = ([(*got[:2], "")], got[2]) if got else ([], None)
            whole = bool(got)
        if at < read:
            fresh = [r for r in rows if not r[0] or key(*r[:2]) not in known]
            if len(fresh) < len(rows) and not any(f for f, _, _ in fresh):
                whole, why = False, why or "record of the member before"
            rows = fresh
        if whole or any(f for f, _, _ in rows):
            stop = end
            if wrong:
                following = _START.search(data, at + 1)
                stop = following.start() if following else len(data)
                known, read = {key(f, b) for f, b, _ in rows if f} | (known if at < read else set()), max(read, end)
            if lost is not None:
                yield lost, at - lost, None, None, reason
                lost = None
            place = at
            for fields, block, fault in rows:
                if not fields:
                    yield place, 0, None, None, fault
                    continue
                stated = fields.get("warc-block-digest", "").startswith("sha1:")
                yield at, stop - at, fields, block, "" if stated else wrong
                place = stop
            at = stop
            continue
        if lost is None:
            lost, reason = at, why
        following = _START.search(data, at + 1)
        at = following.start() if following else len(data)
    if lost is not None:
        yield lost, len(data) - lost, None, None, reason


def _number(text):
    found = re.fullmatch(rf"<{RECORD}(-?\d+)>", text or "")
    return int(found[1]) if found else None


def _hex(text):
    try:
        return base64.b32decode(text.removeprefix("sha1:")).hex() if text else None
    except ValueError:
        return None


def _read(with_payload, batches):
    import pyarrow as pa

    names = ["file", "offset", "length", "status", "record_type", "page_id", "url", "payload_bytes",
             "payload_digest", "refers_to", "payload"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(),
             pa.string(), pa.int64(), pa.binary()]

    def table(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for i in range(batch.num_rows):
            file, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""
            rows, held = [], 0
            for offset, length, fields, block, why in salvage(data):
                if fields is None:
                    rows.append((file, offset, length, why, *[None] * 7))
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                size = re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)
                kind = fields["warc-type"]
                digest, status = _hex(fields.get("warc-payload-digest")), why or "valid"
                if kind == "response" and digest and digest != sha1(payload).hexdigest():
                    status = "payload digest"
                rows.append((
                    file, offset, length, status, kind, _number(fields.get("warc-record-id")),
                    fields.get("warc-target-uri"), int(size[1]) if kind == "revisit" and size else len(payload),
                    digest, _number(fields.get("warc-refers-to")), payload if with_payload and kind == "response" else None))
                held += len(payload) * with_payload
                if len(rows) >= 5_000 or held > 8_000_000:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)


def read_archives(spark, path, with_payload=True):
    """Records and quarantined gaps of the archives below ``path``.

    Columns: ``file, offset, length, status, record_type, page_id, url,
    payload_bytes, payload_digest, refers_to, payload``. ``status`` is ``valid`` for
    a record, else the failed check of a byte range that holds no valid record
    (its other fields are NULL; length 0 inside a member), of the member around a record without a block digest or ``payload digest`` for a record whose payload is not
    what it says. Files may mix gzip members and plain records. A task holds
    one archive at a time; archives above 2 GB are refused by Spark's reader.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(
        partial(_read, with_payload),
        "file string, offset long, length long, status string, record_type string, page_id long, url string, "
        "payload_bytes long, payload_digest string, refers_to long, payload binary")
