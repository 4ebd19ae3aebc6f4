"""Archives read by their index, and signed envelopes read by their tags."""

import base64
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.sources import archives, envelopes


def _zip(members, **kw):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_large_archive_is_dealt_by_its_index(spark, tmp_path):
    r = random.Random(3)
    members = [(f"d{i % 7}/f{i}.txt", r.randbytes(r.randint(0, 30_000))) for i in range(1200)]
    members += [("in.zip", _zip([("x.txt", "deep"), ("../y", "no")])), ("../up", "no"), ("z/.hidden", "no")]
    (tmp_path / "big.zip").write_bytes(_zip(members))
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    (tmp_path / "empty.zip").write_bytes(_zip([]))
    found = archives.read_archives(spark, f"{tmp_path}/*.zip", run_bytes=1_000_000)
    whole = archives.expand_archives(spark.read.format("binaryFile").load(f"{tmp_path}/*.zip").select(F.regexp_extract("path", r"(\w+)\.zip$", 1).alias("case_id"), "content"))
    assert {(x.case_id, x.path, x.problem, bytes(x.content or b"")) for x in found.collect()} == {(x.case_id, x.path, x.problem, bytes(x.content or b"")) for x in whole.collect()}
    assert found.count() == 1200 + 1 + 1 + 1 + 1
    assert len([n for n in found.groupBy(F.spark_partition_id()).count().collect() if n["count"] > 50]) > 2
    limited = archives.read_archives(spark, f"{tmp_path}/big.zip", run_bytes=1_000_000, max_files=700)
    assert limited.filter("problem is null").count() == 700 and [x.path for x in limited.filter("problem = 'limit'").collect()] == ["d0/f700.txt"]
    assert limited.exceptAll(archives.expand_archives(whole.limit(0).select("case_id", "content"))).count() == 701


def _tlv(tag, body, indefinite=False, long=False):
    if indefinite:
        return bytes([tag, 0x80]) + body + b"\x00\x00"
    n = len(body)
    if n < 128 and not long:
        return bytes([tag, n]) + body
    size = n.to_bytes((n.bit_length() + 7) // 8 or 1, "big")
    return bytes([tag, 0x80 | len(size)]) + size + body


def _envelope(document, chunk=None, indefinite=False):
    """A signed envelope: the document whole or in chunks, lengths told or left open; certificates and signatures follow."""
    parts = _tlv(0x04, document) if chunk is None else _tlv(0x24, b"".join(_tlv(0x04, document[i : i + chunk]) for i in range(0, len(document), chunk)), indefinite)
    content = _tlv(0x30, envelopes.DATA + _tlv(0xA0, parts, indefinite), indefinite)
    signed = _tlv(0x30, _tlv(0x02, b"\x01") + _tlv(0x31, _tlv(0x30, bytes.fromhex("0609608648016503040201"))) + content + _tlv(0xA0, _tlv(0x30, b"\x05\x00" * 40)) + _tlv(0x31, b""), indefinite)
    return _tlv(0x30, bytes.fromhex("06092a864886f70d010702") + _tlv(0xA0, signed, indefinite), indefinite)


@pytest.mark.parametrize("size", [0, 1, 127, 128, 5000, 70_000])
@pytest.mark.parametrize("chunk", [None, 1000])
@pytest.mark.parametrize("indefinite", [False, True])
def test_envelope_round_trip(size, chunk, indefinite):
    document = random.Random(size).randbytes(size)
    made = _envelope(document, chunk, indefinite)
    assert envelopes.signed_document(made) == document
    assert envelopes.signed_document(base64.encodebytes(made)) == document
    assert envelopes.signed_document(b"-----BEGIN PKCS7-----\n" + base64.encodebytes(made) + b"-----END PKCS7-----\n") == document
    assert envelopes.signed_document(_envelope(made, 100, not indefinite)) == made


def test_damaged_envelopes_end():
    made = _envelope(b"document" * 100, 64, True)
    r = random.Random(5)
    for _ in range(3000):
        bad = bytearray(made)
        for _ in range(r.randint(1, 4)):
            bad[r.randrange(len(bad))] = r.randrange(256)
        envelopes.signed_document(bytes(bad[: r.randint(0, len(bad))]))
    assert envelopes.signed_document(b"\x30\x80" * 10_000) is None


def test_envelopes_to_text(spark):
    docx = _zip([("word/document.xml", '<w:d xmlns:w="w"><w:p><w:t>Signed</w:t></w:p><w:p><w:t>text</w:t></w:p></w:d>')])
    rows = [
        ("c", "a.docx.p7m", _envelope(docx, 50, True)),
        ("c", "b.txt.p7m.P7M", _envelope(_envelope("già firmato".encode(), 3), None, True)),
        ("c", "c.p7m", _envelope(_zip([("in/x.txt", "member"), ("y.p7m", b"x")]), 1000)),
        ("c", "d.p7m", b"no envelope"),
        ("c", "e.p7m", None),
        ("c", "f.p7m", b"\x01\x02%PDF-1.4 abc%%EOF\x00"),
        ("c", "g.txt", b"plain"),
    ]
    df = spark.createDataFrame([(a, b, bytearray(c) if c is not None else None) for a, b, c in rows], "case_id string, path string, content binary")
    out = {r.path: (r.category, r.text, r.method) for r in archives.extract_text(df).collect()}
    assert out == {
        "a.docx.p7m/a.docx": ("word", "Signed\ntext", "ok"),
        "b.txt.p7m.P7M/b.txt.p7m/b.txt": ("text", "già firmato", "ok"),
        "c.p7m/c.zip/in/x.txt": ("text", "member", "ok"),
        "c.p7m/c.zip/y.p7m": ("p7m", None, "no_handler"),
        "d.p7m": ("p7m", None, "no_payload"),
        "e.p7m": ("p7m", None, "missing"),
        "f.p7m/f.pdf": ("pdf", None, "no_handler"),
        "g.txt": ("text", "plain", "ok"),
    }
    shallow = {(r.path, r.problem) for r in archives.carve_embedded(df.filter("path like 'b%'"), max_depth=1).collect()}
    assert shallow == {("b.txt.p7m.P7M/b.txt.p7m", "too_deep")}


ODD = [None, "", " \n\t", "a b\u00a0", "\u2003x\u2028y\u3000", "\u00a0", "a\x0bb", "\x0ca\x0c", "\x00", "a\x01b \x08 \x1fc\x1c", "\x85a\x85b", "a\ufffeb \uffff", "\x0b\ue000 & <b> \ue001", "PK\x03\x04 a", "a\r\nb\rc"]


def test_odd_documents_in_all_formats_as_in_sql(spark, tmp_path):
    """texts that are missing, blank or hold characters that XML forbids or only Python calls white space, and ids without a format."""
    import duckdb

    from paperloom.plans import registry

    rows = [(i * 9 + k, t) for i, t in enumerate(ODD) for k in range(9)] + [(k, "a") for k in (-1, -9, -5, 2**62 + 1, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["s03_extract_text"]).fetchall()
    got = registry.queries()["s03_extract_text"](spark, str(tmp_path))
    assert len(want) == 9 * len(ODD) + 2 and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_blank_and_forbidden_characters(spark):
    xml = '<?xml version="1.0"?><d>\n <a>x\x0b\ufffe\ue000</a> <b>\x00</b>\u00a0</d>'
    assert archives.HANDLERS["xml"](xml.encode()) == "x\x0b\ufffe\ue000\x00\u00a0"
    for bad in (b"<d>\x0b</e>", b"<d>\xff\x0b</d>", b"<d>"):
        with pytest.raises(archives.ElementTree.ParseError):
            archives.HANDLERS["xml"](bad)
    assert archives.visible_text("<p>\u00a0a \t b\x0c\r\u2003 c\n\n d</p>") == "\u00a0a b \u2003 c\nd"
    df = spark.createDataFrame([("c", bytearray(_zip([("a.txt", " \n"), ("b.txt", "\x1f"), ("c.txt", "short")])))], "case_id string, content binary")
    assert {r.path: (r.method, r.enough) for r in archives.ingest(df).collect()} == {"a.txt": ("empty", False), "b.txt": ("empty", False), "c.txt": ("ok", False)}
