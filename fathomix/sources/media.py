"""Readers of media: images, PDF pages, video frames and speech.

Each is a plain function of a file's bytes, made in the task that uses it. Decoders are
optional. Where one is missing, or fails on a file, it raises, and the caller makes that
the file's error.
"""

from __future__ import annotations

import io
import os
import struct
import subprocess
import tempfile

def image_size(raw: bytes) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF, BMP or JPEG; None for anything else."""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", raw[16:24])
        if raw[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", raw[6:10])
        if raw[:2] == b"BM":
            width, height = struct.unpack("<ii", raw[18:26])
            return width, abs(height)
        if raw[:2] == b"\xff\xd8":
            at = 2
            while raw[at] == 0xFF:
                marker, length = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
                    return width, height
                at += 2 + length
    except (struct.error, IndexError):
        pass
    return None


def read_pdf(raw: bytes) -> list[str]:
    """The text of each page; a page that fails is empty."""
    from pypdf import PdfReader

    pages = []
    for page in PdfReader(io.BytesIO(raw)).pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001
            pages.append("")
    return pages


def read_image(raw: bytes) -> tuple[int, int, bytes]:
    """(width, height, pixels): RGB bytes where a decoder is there, the file's own bytes of a known form else."""
    try:
        from PIL import Image
    except ImportError:
        size = image_size(raw)
        if size is None:
            raise ValueError("no image of a known form") from None
        return *size, raw
    with Image.open(io.BytesIO(raw)) as image:
        rgb = image.convert("RGB")
        return rgb.width, rgb.height, rgb.tobytes()


def _tool(arguments: list[str], raw: bytes, suffix: str) -> list[tuple[str, bytes]]:
    """Runs a tool in a folder of the task's own, which goes with it: the files it made."""
    with tempfile.TemporaryDirectory() as folder:
        source = os.path.join(folder, f"in{suffix}")
        with open(source, "wb") as f:
            f.write(raw)
        subprocess.run([a.format(source=source, folder=folder) for a in arguments], check=True, capture_output=True)
        out = []
        for name in sorted(os.listdir(folder)):
            if name != f"in{suffix}":
                with open(os.path.join(folder, name), "rb") as f:
                    out.append((name, f.read()))
        return out


def read_frames(raw: bytes, suffix: str, every_s: float = 2.0, most: int = 2000) -> list[tuple[int, bytes]]:
    """(timestamp_ms, image) of a video by ffmpeg; times go by number."""
    every_s = max(0.1, every_s)
    made = _tool(["ffmpeg", "-i", "{source}", "-vf", f"fps=1/{every_s}", "-frames:v", str(most), "{folder}/%08d.png"], raw, suffix)
    return [(int(i * every_s * 1000), image) for i, (_, image) in enumerate(made)]


def read_sound(raw: bytes, suffix: str) -> bytes | None:
    """The sound of a video or audio file as mono WAV of 16 kHz, by ffmpeg; None if it has none."""
    try:
        made = _tool(["ffmpeg", "-i", "{source}", "-vn", "-ac", "1", "-ar", "16000", "{folder}/out.wav"], raw, suffix)
    except subprocess.CalledProcessError:
        return None
    return made[0][1] if made else None
