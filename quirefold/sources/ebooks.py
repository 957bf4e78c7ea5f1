"""Reading e-book files: EPUB by the standard library, conversion of other formats by an outside tool."""

from __future__ import annotations

import io
import posixpath
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

RECORD = "source_path string, kind string, ord int, item_id string, name string, media_type string, title string, content string"
CONVERTER, TIMEOUT_S = "ebook-convert", 120


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def records(path: str, data: bytes) -> Iterator[tuple]:
    """Rows of RECORD of one EPUB: its metadata, manifest items, spine and table of contents; a damaged file gives one row of kind `error`."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in root.iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
        base = posixpath.dirname(opf)
        items = {}
        n = 0
        for e in package.iter():
            if _local(e.tag) in ("title", "creator") and (e.text or "").strip():
                yield (path, "meta", n, None, _local(e.tag), None, e.text.strip(), None)
                n += 1
        for i, e in enumerate(e for e in package.iter() if _local(e.tag) == "item"):
            name = posixpath.normpath(posixpath.join(base, unquote(e.attrib["href"])))
            kind = e.attrib.get("media-type", "")
            items[e.attrib["id"]] = (name, kind)
            text = z.read(name).decode("utf-8", "replace") if kind == "application/xhtml+xml" and name in z.namelist() else None
            yield (path, "item", i, e.attrib["id"], name, kind, None, text)
        for i, e in enumerate(e for e in package.iter() if _local(e.tag) == "itemref"):
            yield (path, "spine", i, e.attrib["idref"], None, None, None, None)
        ncx = next((v[0] for v in items.values() if v[1] == "application/x-dtbncx+xml"), None)
        if ncx:
            points = [p for p in ElementTree.fromstring(z.read(ncx)).iter() if _local(p.tag) == "navPoint"]
            for i, p in enumerate(points):
                if any(_local(c.tag) == "navPoint" for c in p):
                    continue  # a section: only leaves link
                href = next((c.attrib["src"] for c in p if _local(c.tag) == "content"), "")
                label = next(("".join(c.itertext()).strip() for c in p if _local(c.tag) == "navLabel"), "")
                yield (path, "toc", i, None, posixpath.normpath(posixpath.join(posixpath.dirname(ncx), unquote(href))), None, label, None)
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
        yield (path, "error", 0, None, type(e).__name__, None, str(e)[:2000], None)


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """The RECORD rows of all EPUB files under a path (a glob too). Files are decoded one by one in the tasks that read them."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(list(records(p, bytes(c))), columns=[f.split()[0] for f in RECORD.split(", ")])

    return files.mapInPandas(run, RECORD)


def require_tool(name: str) -> str:
    """Path of an outside tool; an error where it is not installed."""
    found = shutil.which(name)
    if not found:
        raise RuntimeError(f"{name} is not installed")
    return found


def convert(path: str) -> str:
    """A book in another format converted to EPUB on the driver; the new file's path."""
    tool = require_tool(CONVERTER)
    out = str(Path(tempfile.mkdtemp(prefix="quirefold-convert-")) / (Path(path).stem + ".epub"))
    done = subprocess.run([tool, path, out], capture_output=True, text=True, timeout=TIMEOUT_S, check=False)
    if done.returncode:
        raise RuntimeError(f"conversion failed: {done.stderr[-2000:]}")
    return out
