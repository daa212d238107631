"""Plug-ins for PDF files and recognition, where the libraries they need are installed.

`pdf_pages` is a page reader for sources.pdf.read_pages (PyMuPDF); `TesseractEngine` one for
operators.spans.recognise (pytesseract, Pillow, PyMuPDF). Both import their libraries on the worker.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import cache

from foliant.operators.spans import OcrUnavailable

# ---- Fixed values: rendering and recognition ----
DPI, MOST_PIXELS, RECOGNITION = 180, 1400, "--psm 3 --oem 1"
NO_BINDINGS, NO_COMMAND = "pytesseract/Pillow missing in this Python", "tesseract.exe not on PATH"
WINDOWS_COMMANDS = (r"C:\Program Files\Tesseract-OCR\tesseract.exe", r"C:\Program Files (x86)\Tesseract-OCR\tesseract.exe")


def pdf_pages(content: bytes, max_pages: int | None = None) -> Iterator[dict]:
    """Pages of a PDF file as read_pages wants them."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for number, page in enumerate(doc, 1):
            if max_pages is not None and number > max_pages:
                return
            yield {
                "page": number, "page_width": float(page.rect.width), "page_height": float(page.rect.height),
                "plain_text": page.get_text("text") or "", "has_images": bool(page.get_images(full=True)),
                "blocks": [_block(b) for b in page.get_text("dict").get("blocks", [])],
            }


def _block(block: dict) -> dict:
    span = lambda s: {"text": s.get("text"), "font": s.get("font"), "size": s.get("size"), "flags": s.get("flags"), "bbox": list(s.get("bbox") or [])}
    return {"type": block.get("type", 0), "lines": [[span(s) for s in line.get("spans", [])] for line in block.get("lines", [])]}


def find_tesseract(
    env: Mapping[str, str] = os.environ, is_file: Callable[[str], bool] = os.path.isfile, which: Callable[[str], str | None] = shutil.which
) -> str | None:
    """The command: that of TESSERACT_CMD, else one on the path, else one where Windows has it."""
    named = env.get("TESSERACT_CMD")
    if named and is_file(named):
        return named
    return which("tesseract") or which("tesseract.exe") or next((c for c in WINDOWS_COMMANDS if is_file(c)), None)


def status(find: Callable[[], str | None] = find_tesseract) -> dict:
    """(available, cmd, reason) of this machine."""
    command = find()
    try:
        import PIL  # noqa: F401
        import pytesseract  # noqa: F401
    except ImportError:
        return {"available": False, "cmd": command, "reason": NO_BINDINGS}
    return {"available": command is not None, "cmd": command, "reason": "ready" if command else NO_COMMAND}


@dataclass
class TesseractEngine:
    """Words of a page (a row with the file's `content` and its `page`), in points from the page's corner."""

    dpi: int = DPI
    most_pixels: int = MOST_PIXELS

    def __call__(self, row: dict, timeout: float) -> list[dict]:
        found = _status()
        if not found["available"]:
            raise OcrUnavailable(found["reason"])
        import fitz
        import pytesseract
        from PIL import Image

        pytesseract.pytesseract.tesseract_cmd = found["cmd"]
        with fitz.open(stream=row["content"], filetype="pdf") as doc:
            page = doc[row["page"] - 1]
            size, scale = page.rect, self.dpi / 72.0
            drawn = page.get_pixmap(matrix=fitz.Matrix(scale, scale), colorspace=fitz.csGRAY, alpha=False)
        image = Image.frombytes("L", (drawn.width, drawn.height), drawn.samples)
        if image.width > self.most_pixels:
            image = image.resize((self.most_pixels, max(1, image.height * self.most_pixels // image.width)), Image.BILINEAR)
        data = pytesseract.image_to_data(image, config=RECOGNITION, output_type=pytesseract.Output.DICT, timeout=max(1, int(timeout)))
        return words(data, size.x0, size.y0, size.width / max(1, image.width), size.height / max(1, image.height))


@cache
def _status() -> dict:
    return status()


def words(data: Mapping[str, list], left: float, top: float, across: float, down: float) -> list[dict]:
    """Rows (schema OCR_WORDS without doc_id and page) of recognised data, from pixels to points."""
    out = []
    for k, text in enumerate(data["text"]):
        x, y, w, h = (data[c][k] for c in ("left", "top", "width", "height"))
        try:
            conf = float(data["conf"][k])
        except (TypeError, ValueError):
            conf = -1.0
        box = {"x0": left + x * across, "y0": top + y * down, "x1": left + (x + w) * across, "y1": top + (y + h) * down}
        ids = {c: int(data[c][k]) for c in ("block_num", "par_num", "line_num")}
        out.append({**ids, "text": (text or "").strip(), "conf": conf, **{c: round(v, 2) for c, v in box.items()}})
    return out
