"""Word lattice, zipped XML documents and PDF pages, on files made here."""

import io
import itertools
import math
import random
import zipfile
import zlib

import pytest

from tessera.operators import chunking, segmenting
from tessera.sources import containers, pdf
from tessera.streaming import ingest


def test_best_path_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        counts = {"".join(rng.choices("甲乙丙", k=rng.randint(1, 4))): rng.randint(1, 90) for _ in range(12)}
        lattice, text = segmenting.Lattice(counts), "".join(rng.choices("甲乙丙丁", k=9))
        total, best = sum(counts.values()) + 1, math.inf
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            parts, at = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(text[at:i])
                    at = i
            if all(p in counts or len(p) == 1 for p in parts):
                best = min(best, sum(math.log(total / counts[p]) if p in counts else lattice.unknown for p in parts))
        got = lattice.words(text)
        assert "".join(got) == text
        assert sum(math.log(total / counts[w]) if w in counts else lattice.unknown for w in got) == pytest.approx(best)


def test_learned_words_are_not_cut(spark):
    rng = random.Random(5)
    lexicon = ["数据库", "知识", "向量检索", "用户", "权限", "文档"]
    texts = ["".join(rng.choice(lexicon) for _ in range(rng.randint(5, 60))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "no such letters")], "doc_id long, text string")
    words = segmenting.learn_words(docs, firmness=4.0)
    counts = {r["word"]: r["n"] for r in words.collect()}
    assert set(lexicon) <= set(counts) and counts["权限"] == sum(t.count("权限") for t in texts)
    segment = segmenting.segmenter({w: counts[w] for w in lexicon} | {w: n for w, n in counts.items() if len(w) == 1})
    text = texts[0] + " and Latin words " + texts[1]
    assert "".join(segment(text)) == text and set(segment(texts[0])) <= set(lexicon)
    rows = chunking.chunk_texts(docs.where("doc_id < 900"), "doc_id", "fixed", 20, segment).collect()
    for r in rows:
        rest = r["content"]
        assert len(rest) <= 20 and any(rest.endswith(w) for w in lexicon)
    assert segmenting.learn_words(docs.limit(0)).count() == 0


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def rels(targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in targets.items()) + "</Relationships>"


DOCX = archive({"word/document.xml": f"<w:document {W}><w:body><w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>One </w:t><w:t>two</w:t></w:r><w:r><w:tab/><w:t>三</w:t><w:delText>gone</w:delText></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
XLSX = archive({
    "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="B" r:id="r2"/><sheet name="A" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": rels({"r1": "worksheets/sheet1.xml", "r2": "/xl/worksheets/sheet2.xml"}),
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>x</t></is></c><c><v>4.5</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>",
})
PPTX = archive({
    "ppt/presentation.xml": f'<p:presentation xmlns:p="p" {R}><p:sldIdLst><p:sldId id="1" r:id="b"/><p:sldId id="2" r:id="a"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": rels({"a": "slides/slide1.xml", "b": "slides/slide2.xml"}),
    "ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>last</a:t></a:r></a:p></p:sld>',
    "ppt/slides/slide2.xml": '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>first</a:t></a:r><a:br/><a:r><a:t>line</a:t></a:r></a:p></p:sld>',
})
EPUB = archive({
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
    "OPS/book.opf": '<package><manifest><item id="x" href="one%20a.xhtml"/><item id="y" href="two.xhtml"/></manifest><spine><itemref idref="y"/><itemref idref="x"/></spine></package>',
    "OPS/one a.xhtml": '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>no</title></head><body><p>The <b>end</b>.</p></body></html>',
    "OPS/two.xhtml": '<html xmlns="http://www.w3.org/1999/xhtml"><body><h1>Start</h1><p>a<br/>b</p><script>no()</script></body></html>',
})
ODT = archive({"content.xml": '<o:document-content xmlns:o="o" xmlns:t="t"><o:body><t:h>Head</t:h><t:p>a<t:s t:c="3"/>b<t:tab/>c</t:p></o:body></o:document-content>'})


def test_containers_by_their_content():
    assert ingest.parse("x.bin", DOCX) == [(None, "One two\t三\n\ncell")]
    assert ingest.parse("x.xlsx", XLSX) == [(1, ""), (2, "name\tvalue\nx\t4.5")]
    assert ingest.parse("x.pptx", PPTX) == [(1, "first\nline"), (2, "last")]
    assert ingest.parse("x.epub", EPUB) == [(1, "Start\na\nb"), (2, "The end.")]
    assert ingest.parse("x.odt", ODT) == [(None, "Head\na   b\tc")]
    for bad in (b"PK\x03\x04 broken", archive({"a.txt": "x"}), archive({"word/document.xml": "<w:p>"}), XLSX[:200]):
        with pytest.raises(ValueError, match="container|archive"):
            ingest.parse("x.docx", bad)
    assert containers.ZIP_MAGIC == DOCX[:4]


def make_pdf(contents, fonts="", extra=b"", packed=False):
    """A file with a page for each stream of operators; `packed` puts the page objects into an object stream."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << %s >> >> >>" % (len(contents), b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents))), fonts.encode())}
    streams = {}
    for i, c in enumerate(contents):
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        streams[11 + 2 * i] = zlib.compress(c)
    out = b"%PDF-1.5\n% a comment with ( in it\n"
    if packed:
        bodies, heads, at = [], [], 0
        for n, body in objects.items():
            heads.append(b"%d %d" % (n, at))
            bodies.append(body)
            at += len(body) + 1
        head = b" ".join(heads) + b" "
        body = zlib.compress(head + b" ".join(bodies))
        out += b"90 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (len(objects), len(head), len(body), body)
    else:
        out += b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items())
    for n, body in streams.items():
        out += b"%d 0 obj << /Length 99 0 R /Filter [/FlateDecode] >>\nstream\r\n%s\nendstream\nendobj\n" % (n, body)
    return out + extra + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_pages():
    pages = [b"BT /F1 12 Tf 72 700 Td (Hello \\(big\\) w\\157rld) Tj 0 -14 Td [(Sec) 20 (ond) -300 (line)] TJ T* (third) ' ET", b"", b"BT /F2 9 Tf 1 0 0 1 5 5 Tm <00010002> Tj ET"]
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0002> <0003> <6587> endbfrange"
    extra = b"50 0 obj << /Type /Font /Subtype /Type0 /ToUnicode 51 0 R >> endobj 51 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    for packed in (False, True):
        got = pdf.parse_pdf(make_pdf(pages, "/F1 << /Type /Font /Subtype /Type1 >> /F2 50 0 R", extra, packed))
        assert got == [(1, "Hello (big) world\nSecond line\nthird"), (2, ""), (3, "中文")]
    for bad in (b"%PDF-1.4", b"%PDF-1.4 /Encrypt 4 0 R", b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj 2 0 obj << /Length 3 /Filter /DCTDecode >> stream\nabc endstream"):
        if b"DCT" in bad:
            assert pdf.parse_pdf(bad) == [(1, "")]
            continue
        with pytest.raises(ValueError, match="PDF"):
            pdf.parse_pdf(bad)


def test_pages_become_chunks_with_running_ids(spark):
    file = make_pdf([b"BT (one page) Tj ET", b"", b"BT (" + b"word " * 200 + b") Tj ET"])
    rows = ingest.chunk_files(spark.createDataFrame([("/a/b.pdf", bytearray(file)), ("/a/c.pdf", bytearray(file[:40]))], "path string, content binary")).orderBy("path", "chunk_id").collect()
    assert [(r["chunk_id"], r["page_number"]) for r in rows if r["path"] == "/a/b.pdf"] == [(1, 1), *((2 + i, 3) for i in range(len(chunking.fixed_chunks("word " * 199 + "word"))))]
    assert [r["error"] for r in rows if r["path"] == "/a/c.pdf"] == ["ValueError: a PDF without a page tree"]


def test_learning_cuts_equal_runs_once(spark, monkeypatch):
    plans, written = [], segmenting.written
    monkeypatch.setattr(segmenting, "written", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), written(df, name))[1])
    docs = spark.createDataFrame([("abc ab abc",)] * 40 + [("abc",)] * 20, "text string")
    rows = segmenting.learn_words(docs, letter="[a-z]", longest=3, least=1, firmness=0.0, most=None)
    assert {r["word"]: r["n"] for r in rows.collect()} == {"a": 140, "b": 140, "c": 100, "ab": 140, "bc": 100, "abc": 100}
    assert plans[0].count("Aggregate [") == 2 and plans[0].rindex("Aggregate [r#") > plans[0].index("explode(flatten(")
