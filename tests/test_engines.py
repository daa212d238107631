"""PDF and recognition plug-ins with stand-ins for their libraries; recognition's time; report sinks."""

import json
import sys
from types import ModuleType
from types import SimpleNamespace as N

import pytest
from pyspark.sql import functions as F

from foliant.operators import model, spans
from foliant.plans.extract import lines_from_pages
from foliant.schemas import OCR_WORDS
from foliant.sources import engines, pdf


class Page:
    rect = N(x0=0.0, y0=0.0, width=600.0, height=800.0)

    def __init__(self, text):
        self.text = text

    def get_text(self, kind):
        span = {"text": self.text, "font": "Arial-Bold", "size": 18, "flags": 0, "bbox": (100.0, 100.0, 400.0, 118.0)}
        return self.text if kind == "text" else {"blocks": [{"type": 0, "lines": [{"spans": [span]}]}, {"type": 1}]}

    def get_images(self, full):
        return []

    def get_pixmap(self, **options):
        return N(width=2800, height=400, samples=b"")


class Doc(list):
    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False


def fake(monkeypatch, name, **values):
    made = ModuleType(name)
    made.__dict__.update(values)
    monkeypatch.setitem(sys.modules, name, made)
    return made


def opened(stream, filetype):
    if stream != b"pdf":
        raise ValueError("no PDF")
    return Doc([Page("Design of a Dryer"), Page("Next"), Page("Last")])


def test_pdf_pages(monkeypatch):
    fake(monkeypatch, "fitz", open=opened)
    rows = list(engines.pdf_pages(b"pdf", 2))
    assert [(r["page"], r["plain_text"], r["page_width"], r["has_images"]) for r in rows] == [(1, "Design of a Dryer", 600.0, False), (2, "Next", 600.0, False)]
    assert rows[0]["blocks"][0]["lines"][0][0]["bbox"] == [100.0, 100.0, 400.0, 118.0] and rows[0]["blocks"][1] == {"type": 1, "lines": []}


def test_finding_tesseract():
    none = lambda c: None
    assert engines.find_tesseract({"TESSERACT_CMD": "/x/t"}, lambda p: p == "/x/t", none) == "/x/t"
    assert engines.find_tesseract({"TESSERACT_CMD": "/x/t"}, lambda p: False, lambda c: "/bin/t" if c == "tesseract" else None) == "/bin/t"
    assert engines.find_tesseract({}, lambda p: p == engines.WINDOWS_COMMANDS[1], none) == engines.WINDOWS_COMMANDS[1]
    assert engines.find_tesseract({}, lambda p: False, none) is None


def test_tesseract_engine(monkeypatch):
    fake(monkeypatch, "fitz", open=opened, Matrix=lambda a, b: (a, b), csGRAY=1)
    image = N(width=2800, height=400, resize=lambda size, how: N(width=size[0], height=size[1]))
    fake(monkeypatch, "PIL", Image=N(frombytes=lambda *a: image, BILINEAR=1))
    data = {"text": [" Dryer ", None], "conf": ["91.5", "x"], "left": [140, 0], "top": [20, 0], "width": [70, 0], "height": [10, 0], "block_num": [1, 1], "par_num": [1, 1], "line_num": [2, 1]}
    asked = []
    fake(monkeypatch, "pytesseract", pytesseract=N(), Output=N(DICT=1), image_to_data=lambda im, **o: asked.append((im.width, im.height, o["timeout"])) or data)
    assert engines.status(lambda: None) == {"available": False, "cmd": None, "reason": engines.NO_COMMAND}
    monkeypatch.setattr(engines, "_status", lambda: engines.status(lambda: "/bin/t"))
    out = engines.TesseractEngine()({"content": b"pdf", "page": 1}, 20.7)
    assert asked == [(1400, 200, 20)]
    assert out[0] == {"block_num": 1, "par_num": 1, "line_num": 2, "text": "Dryer", "conf": 91.5, "x0": 60.0, "y0": 80.0, "x1": 90.0, "y1": 120.0} and out[1]["conf"] == -1.0


def test_without_bindings_recognition_is_unavailable(monkeypatch):
    monkeypatch.setitem(sys.modules, "pytesseract", None)
    monkeypatch.setattr(engines, "_status", lambda: engines.status(lambda: "/bin/t"))
    with pytest.raises(spans.OcrUnavailable, match="missing"):
        engines.TesseractEngine()({"content": b"pdf", "page": 1}, 20.0)


def test_recognition_keeps_to_a_document_s_time(spark):
    now, asked = [0.0], {1: 30.0, 2: 40.0, 3: 1.0, 4: 1.0}

    def engine(page, timeout):
        now[0] += asked[page["page"]]
        if page["page"] == 3:
            raise ValueError("torn")
        return [{"block_num": 1, "par_num": 1, "line_num": 1, "text": "seen", "conf": 90.0, "x0": 1.0, "y0": 1.0, "x1": 9.0, "y1": 8.0}]

    pages = spark.createDataFrame([(1, p) for p in (4, 2, 3, 1)], "doc_id long, page int")
    found = spans.recognise(pages, engine, lambda: now[0])
    assert [(r.page, r.method, r.error, r.timeout) for r in found.orderBy("page").collect()] == [
        (1, "ocr", None, 45.0), (2, "ocr", None, 20.0), (3, "ocr_failed", "OCR failed: torn", 45.0), (4, "ocr_skipped", "OCR page limit reached", None),
    ]
    words = spans.recognised_words(found)
    assert words.columns == OCR_WORDS.names and words.count() == 2
    assert spans.ocr_lines(words).count() == 2 and spans.recognise(pages.where("false"), engine).count() == 0


def test_environment_files(tmp_path):
    (tmp_path / ".env").write_text("# x\nGEMINI_API_KEY = \"one\"\nGEMINI_API_KEY_2='two'\nno sign\n=lost\nA=b=c\n")
    found = model.load_env([str(tmp_path / "none"), str(tmp_path / ".env")], {"GEMINI_API_KEY": "old", "HOME": "/x"})
    assert found == {"GEMINI_API_KEY": "one", "GEMINI_API_KEY_2": "two", "HOME": "/x", "A": "b=c"}
    assert [k for _, k in model.load_keys(found)] == ["one", "two"]


def test_read_files_to_lines_and_report_sinks(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"pdf")
    (tmp_path / "in" / "b.pdf").write_bytes(b"broken")
    files = pdf.read_files(spark, str(tmp_path / "in"))

    def reader(content, max_pages):
        if content != b"pdf":
            raise ValueError("no PDF")
        box = [100.0, 100.0, 400.0, 118.0]
        span = {"text": "Design of a Dryer", "font": "Arial-Bold", "size": 18.0, "flags": 0, "bbox": box}
        yield {"page": 1, "page_width": 600.0, "page_height": 800.0, "plain_text": "Design of a Dryer by all of us in this town", "has_images": False, "blocks": [{"type": 0, "lines": [[span]]}]}

    pages = pdf.read_pages(files, reader)
    assert sorted((r.page or 0, r.error or "") for r in pages.collect()) == [(0, "Could not read PDF: no PDF"), (1, "")]
    lines, _ = lines_from_pages(pages.where("error is null"))
    assert [r.text for r in pdf.first_lines(lines).collect()] == ["Design of a Dryer"]
    signals = spark.createDataFrame([(1, {"bold": 5.0, "caps": -7.04, "none": 0.0})], "doc_id long, signals map<string,double>")
    assert [(s.name, s.value) for s in pdf.top_signals(signals).first().signals] == [("caps", -7.0), ("bold", 5.0)]
    assert pdf.preview(lines, 6).first().preview == "Design"
    pdf.write_json(lines.select("text", F.lit(1).alias("n")), str(tmp_path / "out"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"text": "Design of a Dryer", "n": 1}]
