"""Joining the sound of chunks to chapters and of chapters to books, and probing durations.

Chunks of a chapter, and chapters of a book, are joined by one task each. The encoder is a parameter:
the one given here joins wave files of one format by the standard library; an outside program can
stand in its place.
"""

from __future__ import annotations

import io
import logging
import wave
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = logging.getLogger("quirefold.audio")
Encoder = Callable[[list[bytes]], bytes]


def probe(data: bytes | None) -> float:
    """Seconds of a wave file; 0 for what is none."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            return w.getnframes() / w.getframerate()
    except (wave.Error, EOFError, ZeroDivisionError):
        return 0.0


def join_waves(parts: list[bytes]) -> bytes:
    """One wave file of several; an error where there is none, or where their formats differ."""
    if not parts:
        raise ValueError("nothing to join")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        kind = None
        for p in parts:
            with wave.open(io.BytesIO(p)) as r:
                if kind is None:
                    kind = r.getparams()[:3]
                    w.setnchannels(kind[0])
                    w.setsampwidth(kind[1])
                    w.setframerate(kind[2])
                elif r.getparams()[:3] != kind:
                    raise ValueError(f"formats differ: {r.getparams()[:3]} and {kind}")
                w.writeframes(r.readframes(r.getnframes()))
    return out.getvalue()


def durations(df: DataFrame, audio: str = "audio") -> DataFrame:
    """df with duration_s, probed from the sound; 0 for what is none."""
    return df.withColumn("duration_s", F.pandas_udf(lambda s: s.map(probe), "double")(audio))


def assemble_chapters(sound: DataFrame, encoder: Encoder = join_waves) -> DataFrame:
    """(book_id, chapter_idx, audio, duration_s) of the sound of chunks (book_id, chapter_idx, chunk_idx, audio), in their order; a single chunk is encoded too."""

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        audio = encoder([bytes(x) for x in rows.sort_values("chunk_idx")["audio"]])
        return pd.DataFrame({"book_id": [key[0]], "chapter_idx": [key[1]], "audio": [audio], "duration_s": [probe(audio)]})

    parts = sound.where("audio is not null").select("book_id", "chapter_idx", "chunk_idx", "audio")
    return parts.groupBy("book_id", "chapter_idx").applyInPandas(join, "book_id long, chapter_idx int, audio binary, duration_s double")


def bundle_books(chapters: DataFrame, documents: DataFrame, encoder: Encoder = join_waves) -> DataFrame:
    """(book_id, audio, document, error) of each book with more than one chapter: its chapters joined, and its FFMETADATA document.

    chapters: book_id, chapter_idx, audio; documents: book_id, document. A book whose chapters can't be
    joined keeps them: it gets a null audio and the error, and the others go on.
    """

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        audio, error = None, None
        try:
            audio = encoder([bytes(x) for x in rows.sort_values("chapter_idx")["audio"]])
        except Exception as e:  # noqa: BLE001  whatever the encoder raises stays with its book
            error = f"{type(e).__name__}: {e}"
            LOG.warning("book %s: %s", key[0], error)
        return pd.DataFrame({"book_id": [key[0]], "audio": [audio], "error": [error]})

    several = chapters.groupBy("book_id").count().where("count > 1").select("book_id")
    joined = chapters.select("book_id", "chapter_idx", "audio").join(several, "book_id", "left_semi").groupBy("book_id").applyInPandas(join, "book_id long, audio binary, error string")
    return joined.join(documents.select("book_id", "document"), "book_id", "left").select("book_id", "audio", "document", "error")


def encode_with(program: str, arguments: Iterable[str]) -> Encoder:
    """An encoder that gives the joined wave file to an outside program on its input and takes its output; an error where it fails."""
    import subprocess

    from ..sources.ebooks import require_tool

    arguments = list(arguments)

    def encode(parts: list[bytes]) -> bytes:
        done = subprocess.run([require_tool(program), *arguments], input=join_waves(parts), capture_output=True, check=False)
        if done.returncode:
            raise RuntimeError(f"{program} failed: {done.stderr[-2000:].decode('utf-8', 'replace')}")
        return done.stdout

    return encode
