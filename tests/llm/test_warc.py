import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sitegraph.llm import warc


def pages(spark, extra=False):
    body = "<html>" + "x" * 1200 + "</html>"
    rows = [(1, "http://b/x", body), (2, "http://a/x", body), (3, "http://a/ y\n", "short"), (4, None, "short"),
            (5, "http://c", None), (6, "http://c", ""), (7, "http://d", "ü" * 800), (7, "http://d", "ü" * 800),
            (8, "http://d", "ü" * 800), (None, "http://e", body), (9, "http://e", "é" * 500_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return df.withColumns({"digest": F.lit(1), "salt": F.lit(2), "member": F.lit("m"), "id": F.lit(0)}) if extra else df


def expected(rows):
    out = []
    for r in rows:
        data = (r.html or "").encode()
        same = [x.page_id for x in rows if (x.html or "").encode() == data]
        first = max((k for k in same if k is not None), default=None)
        revisit = len(data) >= 1000 and len(same) > 1 and r.page_id != first
        out.append((r.page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
                    first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("extra", [False, True])
def test_round_trip(spark, tmp_path, extra, monkeypatch):
    if extra:
        monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)  # by the salted join
    df = pages(spark, extra)
    manifest = warc.write_warc(df, f"file://{tmp_path}/a", roll_bytes=2000)
    back = warc.read_warc(spark, f"file://{tmp_path}/a")
    got = sorted((tuple(r)[:5] for r in back.collect()), key=repr)
    assert got == expected(df.collect())
    assert manifest.count() > 1
    assert not (tmp_path / "a/_temporary").exists()


def test_files_depend_on_the_records_alone(spark, tmp_path):
    df = pages(spark)
    one = {tuple(r) for r in warc.write_warc(df, f"file://{tmp_path}/a", roll_bytes=1500).collect()}
    two = {tuple(r) for r in warc.write_warc(df.repartition(5), f"file://{tmp_path}/b", roll_bytes=1500).collect()}
    assert one == two
    for name, records, size, sha1 in one:
        data = (tmp_path / "b" / name).read_bytes()
        assert (len(data), hashlib.sha1(data).hexdigest()) == (size, sha1)
        members = []
        while data:
            z = zlib.decompressobj(31)
            members.append(z.decompress(data))
            data = z.unused_data
        assert len(members) == records
        for m in members:
            headers, block = warc.parse_record(m)
            assert headers["warc-block-digest"] == warc.sha1_base32(block)


def test_empty_table(spark, tmp_path):
    manifest = warc.write_warc(pages(spark).limit(0), f"file://{tmp_path}/a")
    assert manifest.count() == 0
    assert warc.read_warc(spark, f"file://{tmp_path}/a").count() == 0


def test_damage_is_found(spark, tmp_path):
    record = warc.make_record(1, b"http://a", b"payload", None, False)
    with pytest.raises(ValueError):
        warc.read_record(record.replace(b"payload", b"paylord"), "f")
    with pytest.raises(ValueError):
        warc.parse_record(record[:-1])
