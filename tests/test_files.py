import io
import json
import zipfile

import pytest

from lodestone.sources import files

LATIN = "Été à la plage, où les élèves français mangèrent très tôt. " * 3
CHINESE = "公司的营业收入主要来自产品销售，本年度净利润较上年同期有所增长。管理层认为市场需求仍然稳定。" * 3
TAIWAN = "公司的營業收入主要來自產品銷售，本年度淨利潤較上年同期有所增長。管理層認為市場需求仍然穩定。" * 3


@pytest.mark.parametrize(
    ("text", "encoding", "found"),
    [
        ("plain", "ascii", "utf-8"), (LATIN, "utf-8", "utf-8"), (CHINESE, "utf-8", "utf-8"), (LATIN, "utf-8-sig", "utf-8-sig"), (CHINESE, "utf-16", "utf-16"), (LATIN, "utf-16-le", "utf-16-le"), (LATIN, "utf-16-be", "utf-16-be"),
        (CHINESE, "utf-32", "utf-32"), (LATIN, "cp1252", "cp1252"), (LATIN + "\x81", "latin-1", "latin-1"), (CHINESE, "gb18030", "gb18030"), (CHINESE, "gbk", "gb18030"), (TAIWAN, "big5", "big5"), ("", "utf-8", "utf-8"), ("èéuxéê çàù " * 9, "cp1252", "cp1252"), ("ÄÖÜ über Öl, Äpfel, größer " * 5, "cp1252", "cp1252"),
    ],
)
def test_encodings_are_told_by_their_bytes(text, encoding, found):
    raw = text.encode(encoding)
    assert files.encoding_of(raw) == found and raw.decode(found) == text


def test_capitals_with_accents_side_by_side_are_western():
    for text in ("TAQUE!! LA!! COÍBO!! ASÍÍCO!! " * 5, "Ééon. Le èêou", "Çèen", "Relepa ai èê èê Èê èê"):
        assert files.encoding_of(text.encode("latin-1")) == "cp1252", text
    for text in ("ABC公司 2019年 A股B股 CEO的 " * 5, "2019年", "FY 2019年3月5日", "中", "Plan 中"):
        assert files.encoding_of(text.encode("gb18030")) == "gb18030", text


def docx(paragraphs, rows):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "".join(f"<w:tr>{''.join(f'<w:tc>{p(c)}</w:tc>' for c in row)}</w:tr>" for row in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as packed:
        packed.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{table}</w:tbl></w:body></w:document>")
    return out.getvalue()


def test_files_become_rows_or_errors(spark, tmp_path):
    held = {"a.txt": CHINESE.encode("gbk"), "b.HTM": b"<h1>T</h1><p>x &amp; y</p>", "c.docx": docx(["one ", ""], [["a", "", "b"], ["", ""]]), "d.docx": b"no zip", "e.pdf": b"%PDF", "f.xyz": b"x", "g.txt": b" \r\n \r", "h.docx": docx([], [])[:40], "i.txt": b"l1\r\n\r\n\r\n  l2\rl3"}
    for name, raw in held.items():
        (tmp_path / name).write_bytes(raw)
    found = {r.path.rpartition("/")[2]: r for r in files.parsed(files.files_under(spark, str(tmp_path))).collect()}
    assert {n: r.text for n, r in found.items() if r.success} == {"a.txt": CHINESE, "b.HTM": "# T\nx & y", "c.docx": "one\na | b", "i.txt": "l1\nl2\nl3"}
    assert {n: r.error for n, r in found.items() if not r.success} == {"d.docx": "can't be read: BadZipFile", "e.pdf": "needs a reader of its own", "f.xyz": "not one of txt, html, htm, docx", "g.txt": "empty", "h.docx": "can't be read: BadZipFile"}
    assert found["a.txt"].encoding == "gb18030" and found["a.txt"].char_count == len(CHINESE) and found["a.txt"].file_size == 2 * len(CHINESE)
    given = spark.createDataFrame([("x", b"y", " .TXT "), ("z", None, "txt"), (None, b"", None)], "path string, content binary, file_type string")
    assert [(r.path, r.success, r.error) for r in files.parsed(given).collect()] == [("x", True, None), ("z", False, "no content"), (None, False, "not one of txt, html, htm, docx")]
    assert files.parsed(given.limit(0)).count() == 0


def test_json_in_six_encodings(spark):
    value = json.dumps({"k": "值é"}, ensure_ascii=False)
    rows = [(e, value.encode(e)) for e in files.JSON_ENCODINGS] + [("none", b"{"), ("null", None)]
    found = {r.path: (r.json, r.encoding) for r in files.json_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert all(json.loads(found[e][0]) == json.loads(value) for e in files.JSON_ENCODINGS)
    assert found["none"] == found["null"] == (None, None)
    assert [found[e][1] for e in ("utf-8", "utf-8-sig", "utf-16")] == ["utf-8", "utf-8-sig", "utf-16"]
