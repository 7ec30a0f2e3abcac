"""Embedders and transcribers by name, and chains of them. Libraries are imported where they are used, and only then."""

from __future__ import annotations

import importlib
import io
import warnings
from collections.abc import Callable
from functools import partial

import numpy as np

from fathomix.operators.indexing import Embedder, HashEmbedder

Transcriber = Callable[[bytes], list[tuple[float, float, str]]]


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float32)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


class ClipEmbedder:
    """Texts and images in one space, by open_clip and torch."""

    name = "clip"

    def __init__(self, model: str = "ViT-B-32", pretrained: str = "openai", batch: int = 32) -> None:
        import open_clip
        import torch

        self._torch, self._batch = torch, batch
        self._model, _, self._prepare = open_clip.create_model_and_transforms(model, pretrained=pretrained)
        self._tokens = open_clip.get_tokenizer(model)
        self._model.eval()
        self.dim = int(self.embed_texts(["x"]).shape[1])

    def _all(self, items: list, encode: Callable, prepare: Callable) -> np.ndarray:
        with self._torch.no_grad():
            parts = [encode(prepare(items[at : at + self._batch])).cpu().numpy() for at in range(0, len(items), self._batch)]
        return _unit(np.concatenate(parts)) if parts else np.zeros((0, self.dim), np.float32)

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        return self._all(texts, self._model.encode_text, self._tokens)

    def embed_images(self, images: list[bytes]) -> np.ndarray:
        from PIL import Image

        return self._all(images, self._model.encode_image, lambda raw: self._torch.stack([self._prepare(Image.open(io.BytesIO(b)).convert("RGB")) for b in raw]))


class SentenceEmbedder:
    """Texts only, by sentence_transformers."""

    name = "sentence"

    def __init__(self, model: str = "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2", batch: int = 32) -> None:
        from sentence_transformers import SentenceTransformer

        self._model, self._batch = SentenceTransformer(model), batch
        self.dim = int(self._model.get_sentence_embedding_dimension())

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        return _unit(self._model.encode(texts, batch_size=self._batch, show_progress_bar=False))

    def embed_images(self, images: list[bytes]) -> np.ndarray:
        raise NotImplementedError("a text embedder embeds no images")


def whisper(size: str = "tiny") -> Transcriber:
    """Speech to segments (start_s, end_s, text), by whisper."""
    import tempfile

    from whisper import load_model

    model = load_model(size)

    def transcribe(raw: bytes) -> list[tuple[float, float, str]]:
        with tempfile.NamedTemporaryFile(suffix=".wav") as f:
            f.write(raw)
            f.flush()
            return [(float(s["start"]), float(s["end"]), str(s["text"])) for s in model.transcribe(f.name)["segments"]]

    return transcribe


def _named(name: str, known: dict[str, Callable]) -> Callable:
    if name in known:
        return known[name]
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"neither a known name nor module:factory: {name}")
    return getattr(importlib.import_module(module), attribute)


def first_that_works(names: list[str], dim: int) -> Embedder:
    """The first embedder of a chain that can be made here; a warning for each that cannot. An empty chain is an error."""
    known: dict[str, Callable] = {"hash": partial(HashEmbedder, dim), "clip": ClipEmbedder, "sentence": SentenceEmbedder}
    problems = []
    for name in names:
        try:
            return _named(name, known)()
        except Exception as e:  # noqa: BLE001  whatever keeps a library from loading, the chain goes on
            problems.append(f"{name}: {type(e).__name__}: {e}")
            warnings.warn(f"embedder left out: {problems[-1]}", stacklevel=2)
    raise RuntimeError(f"no embedder can be made: {'; '.join(problems) or 'none named'}")


def transcriber(name: str) -> Transcriber:
    return _named(name, {"whisper": whisper})()
