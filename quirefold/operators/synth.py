"""Rendering chunks to sound: the interface, backends by name, and a deterministic stand-in.

A backend is made once in each task and then gets all of its chunks, so that a model loads once.
"""

from __future__ import annotations

import hashlib
import struct
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "book_id long, chapter_idx int, chunk_idx int, audio binary, duration_s double, tokens long"


class Synthesizer(Protocol):
    def synthesize(self, text: str, reference: bytes | None = None) -> tuple[bytes, float, int]:
        """Sound, seconds and tokens used."""
        ...


class Tone:
    """Sound that depends on the text alone: 8-bit samples from a hash, 60 ms for each word."""

    def synthesize(self, text: str, reference: bytes | None = None) -> tuple[bytes, float, int]:
        words = len(text.split())
        seed = hashlib.blake2b(text.encode("utf-8") + (reference or b""), digest_size=32).digest()
        body = (seed * (1 + words * 8 // len(seed)))[: max(8, words * 8)]
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(body))
        return head + body, words * 0.06, words


class Remote:
    """Sound from a service: send(text, reference) is asked again after failures, with growing pauses, at most `rate` times a second in each task.

    send raises on failure and returns (sound, seconds, tokens). It stands for the network, which is
    not here; a secret belongs into the function that makes it on the executor, not into the plan.
    """

    def __init__(self, send: Callable[[str, bytes | None], tuple[bytes, float, int]], tries: int = 3, rate: float = 10.0, pause: float = 0.5):
        self.send, self.tries, self.rate, self.pause = send, tries, rate, pause
        self.last = 0.0

    def synthesize(self, text: str, reference: bytes | None = None) -> tuple[bytes, float, int]:
        for k in range(self.tries):
            time.sleep(max(0.0, self.last + 1 / self.rate - time.monotonic()))
            self.last = time.monotonic()
            try:
                return self.send(text, reference)
            except Exception as e:  # noqa: BLE001  the last failure is raised
                if k + 1 == self.tries:
                    raise RuntimeError(f"no sound after {self.tries} tries: {e}") from e
                time.sleep(self.pause * 2**k)
        raise RuntimeError("no tries")


class Local:
    """Sound from a model that load() brings into the worker's memory when the first text comes; load(device) returns speak(text, reference)."""

    def __init__(self, load: Callable[[str], Callable[[str, bytes | None], tuple[bytes, float, int]]], device: str = "cpu"):
        self.load, self.device, self.speak = load, device, None

    def synthesize(self, text: str, reference: bytes | None = None) -> tuple[bytes, float, int]:
        if self.speak is None:
            self.speak = self.load(self.device)
        return self.speak(text, reference)


BACKENDS: dict[str, Callable[[], Synthesizer]] = {"tone": Tone}


def register(name: str, make: Callable[[], Synthesizer]) -> None:
    """Makes a backend known under a name: `register("api", lambda: Remote(send))`, `register("local", lambda: Local(load))`."""
    BACKENDS[name] = make


def backend(name: str) -> Callable[[], Synthesizer]:
    """The backend registered under a name; an error for other names. `api` and `local` must be registered by who has a network or a model."""
    if name not in BACKENDS:
        raise ValueError(f"unknown backend: {name}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]


def backend_name(of: Synthesizer) -> str:
    """What a backend is called in reports."""
    return type(of).__name__


def render(chunks: DataFrame, name: str = "tone", reference: bytes | None = None) -> DataFrame:
    """The sound of each chunk (book_id, chapter_idx, chunk_idx, text)."""
    make = backend(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = make()
        for b in batches:
            got = [s.synthesize(t, reference) for t in b["text"]]
            yield pd.DataFrame({"book_id": b["book_id"], "chapter_idx": b["chapter_idx"], "chunk_idx": b["chunk_idx"], "audio": [g[0] for g in got], "duration_s": [g[1] for g in got], "tokens": [g[2] for g in got]})

    return chunks.select("book_id", "chapter_idx", "chunk_idx", "text").mapInPandas(run, SCHEMA)
