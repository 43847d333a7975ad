"""Text in pictures: images, scanned pages, frames of videos, and pictures inside office files.

An engine is a function from the bytes of a picture to its text. It is given to ``files.extract`` and travels to the tasks;
without one the installed tesseract is used, and without that every file gives an empty block with a warning. PDF pages and
frames of videos need fitz and cv2.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

Engine = Callable[[bytes], str]
#: Digital text of a page that is enough to go without recognition, least characters of a line, and dots per inch of a rendered page: fixed values.
PAGE_CHARS, LINE_CHARS, DPI = 20, 3, 150
#: Seconds between frames of a video.
EVERY = 1
PICTURE = re.compile(r"(?:^|/)media/[^/]+\.(?:png|jpe?g|gif|bmp|tiff?|webp)$", re.I)
NO_ENGINE = "no OCR engine installed"
VIDEO = (".mp4", ".avi", ".mov", ".mkv")


def installed_engine() -> Engine | None:
    """tesseract by its Python wrapper, if both are there."""
    try:
        import pytesseract
        from PIL import Image, ImageSequence
    except ImportError:
        return None

    def read(raw: bytes) -> str:
        with Image.open(io.BytesIO(raw)) as picture:
            return "\n".join(pytesseract.image_to_string(frame.convert("L")) for frame in ImageSequence.Iterator(picture))

    return read


def clean(text: str, before: str = "") -> str:
    """Lines of a few characters at least, without those that repeat the line before."""
    out: list[str] = []
    for line in (re.sub(r"\s+", " ", x).strip() for x in text.splitlines()):
        if len(line) >= LINE_CHARS and line != (out[-1] if out else before):
            out.append(line)
    return "\n".join(out)


def _block(text: str, place: str | None) -> tuple[str, str | None, list[str]]:
    return text, place, [] if text else ["no text recognised"]


def _pages(raw: bytes, engine: Engine) -> Iterator[tuple]:
    try:
        import fitz
    except ImportError:
        yield "", None, ["no PDF engine installed"]
        return
    with fitz.open(stream=raw, filetype="pdf") as file:
        for k, page in enumerate(file, 1):
            text = page.get_text()
            yield _block(text if len(text.strip()) > PAGE_CHARS else clean(engine(page.get_pixmap(dpi=DPI).tobytes("png"))), str(k))


def _frames(raw: bytes, engine: Engine) -> Iterator[tuple]:
    try:
        import tempfile

        import cv2
    except ImportError:
        yield "", None, ["no video engine installed"]
        return
    with tempfile.NamedTemporaryFile(suffix=".mp4") as file:  # the decoder reads files only; nothing is kept
        file.write(raw)
        file.flush()
        film, last, k = cv2.VideoCapture(file.name), "", 0
        step = max(1, round((film.get(cv2.CAP_PROP_FPS) or 1) * EVERY))
        while film.grab():
            if k % step == 0:
                good, picture = film.retrieve()
                text = clean(engine(cv2.imencode(".png", picture)[1].tobytes()), last) if good else ""
                if text:
                    last = text.splitlines()[-1]
                    yield text, f"second {k // step * EVERY}", []
            k += 1
        film.release()
        if not last:
            yield "", None, ["no text recognised"]


def pictures(raw: bytes, name: str, engine: Engine | None) -> Iterator[tuple]:
    """Blocks of an image, a PDF or a video."""
    engine = engine or installed_engine()
    low = name.lower()
    if engine is None:
        yield "", None, [NO_ENGINE]
    elif raw[:4] == b"%PDF" or low.endswith(".pdf"):
        yield from _pages(raw, engine)
    elif raw[4:8] == b"ftyp" or low.endswith(VIDEO):
        yield from _frames(raw, engine)
    else:
        yield _block(clean(engine(raw)), None)


def embedded(raw: bytes, name: str, engine: Engine | None) -> Iterator[tuple]:
    """A block for each picture inside an office file."""
    engine = engine or installed_engine()
    if engine is None:
        yield "", None, [NO_ENGINE]
        return
    with zipfile.ZipFile(io.BytesIO(raw)) as box:
        found = sorted(n for n in box.namelist() if PICTURE.search(n))
        for part in found:
            yield _block(clean(engine(box.read(part))), part)
    if not found:
        yield "", None, ["no pictures"]


EXTRACTORS = {"ocr_extractor": ("ocr", pictures), "embedded_image_ocr_extractor": ("ocr", embedded)}
