"""Media columns: interleaved document sequences.

:func:`interleave` parses HTML into an ordered sequence of text and media-reference entries;
:func:`stored` writes each payload's stored form to a table in the shared folder, :func:`media_store`
reads the stored bytes back and describes them, one row per digest; :func:`resolve` joins references to the store by digest. Positions and captions stay with
their references, a reference without a payload stays with nulls.

The stored form is a binary PPM image, 64 pixels wide, 8 bits a sample: 192 bytes a row. A
payload is its bytes, filled with blanks (byte 32) to a positive multiple of 192.

Scale: one digest may be referred to by a third of all rows. References are dealt by (digest,
salt), and the store sends each digest once per salt that occurs, so no key holds more than
a 256th of a digest's references. Payloads are stored where they are read, copies within a batch of
rows once, and only descriptors are shuffled.

Null html gives no entries, null text is an empty payload; a payload of any length is one image;
repeated rows resolve to equal rows; entries keep the order of the page, captions of equal references
stay with their own entry; an empty table gives an empty result; further columns of the pages are kept,
except those with the name of an entry's field, which the entry's replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_lookup, whole_text, written

ROW = 192
WIDTH = 64
TAIL = 16

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", re.S | re.I)
_CLOSED = re.compile(r"(?:-->|</(?:script|style)\s*>)\Z", re.I)
_UNCLOSED = re.compile(r"<!--|<(?:script|style)\b", re.I)
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_INLINE = frozenset("a abbr b br cite code em font i kbd mark q s small span strong sub sup u".split())
_MEDIA = frozenset("img video audio source embed picture".split())
ENTRY = "position long, kind string, text string, ref string, digest string, caption string"


# ---------------------------------------------------------------- sequences


def parse_sequence(html: str | None) -> list[tuple]:
    """``(position, kind, text, ref, digest, caption)`` in page order.

    ``kind`` is ``text`` or ``media``. A caption is the figure's ``figcaption``, else the
    ``alt`` text; ``digest`` is the hex part of a ``sha256:`` reference or of ``data-digest``.
    """
    entries: list[list] = []
    words: list[str] = []
    figure: list[int] | None = None
    in_caption = False

    def flush() -> None:
        nonlocal words
        text = " ".join(unescape("".join(words)).split())
        words = []
        if text and in_caption and figure is not None:
            for i in figure:
                entries[i][5] = text
            if not figure:
                figure_caption.append(text)
        elif text:
            entries.append([len(entries), "text", text, None, None, None])

    figure_caption: list[str] = []
    html = html or ""
    at, last = 0, html.rfind(">") + 1
    # no tag ends behind the last >: what opens there is looked for once, not from each <
    for m in _TOKEN.finditer(html, 0, last):
        words.append(html[at : m.start()])
        at = m.end()
        if at == last and not m[3] and not _CLOSED.search(m[0]):
            at = len(html)  # a comment or script that is never closed
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in _INLINE:
            words.append(" " if tag == "br" else "")
            continue
        flush()
        closing = bool(m[2])
        if tag == "figure":
            figure = None if closing else []
            figure_caption.clear()
        elif tag == "figcaption":
            in_caption = not closing
        elif tag in _MEDIA and not closing:
            attrs = {a.lower(): unescape(x or y or z) for a, x, y, z in _ATTR.findall(m[4])}
            ref = attrs.get("src") or attrs.get("srcset")
            if ref:
                digest = attrs.get("data-digest") or (ref[7:] if ref.startswith("sha256:") else None)
                caption = figure_caption[0] if figure is not None and figure_caption else attrs.get("alt") or None
                if figure is not None:
                    figure.append(len(entries))
                entries.append([len(entries), "media", None, ref, digest and digest.lower(), caption])
    words.append(_UNCLOSED.split(html[at:], maxsplit=1)[0])
    flush()
    return [tuple(e) for e in entries]


def interleave(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per entry: the other columns of ``pages`` and the columns of :data:`ENTRY`."""
    keys = [c for c in pages.columns if c not in {html, *(e.split()[0] for e in ENTRY.split(", "))}]
    rows = pages.select(F.col(html).alias("__html"), *[F.col(f"`{c}`") for c in keys])
    entry = f"array<struct<{', '.join(e.replace(' ', ': ') for e in ENTRY.split(', '))}>>"
    schema = rows.select(*[F.col(f"`{c}`") for c in keys], F.lit(None).cast(entry).alias("entries")).schema
    kind = pa.list_(pa.struct([("position", pa.int64()), *((n, pa.string()) for n in ("kind", "text", "ref", "digest", "caption"))]))
    fields = ("position", "kind", "text", "ref", "digest", "caption")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(fields, e, strict=True)) for e in parse_sequence(h)] for h in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, kind)], names=[*keys, "entries"])

    return rows.mapInArrow(run, schema).select(*[F.col(f"`{c}`") for c in keys], F.inline("entries"))


# ---------------------------------------------------------------- payloads


def payload_text(text: Column) -> Column:
    """The text filled with blanks so that its UTF-8 bytes are a positive multiple of 192."""
    n = F.octet_length(text)
    fill = F.when(n == 0, F.lit(ROW)).otherwise(F.pmod(-n, F.lit(ROW)))
    return F.concat(text, F.repeat(F.lit(" "), fill))


def store_form(payload: bytes) -> bytes:
    if not payload or len(payload) % ROW:
        raise ValueError(f"a payload has a positive multiple of {ROW} bytes")
    return b"P6\n%d %d\n255\n" % (WIDTH, len(payload) // ROW) + payload


def read_back(media: bytes) -> np.ndarray:
    """Samples of a stored image, shaped (rows, pixels, channels)."""
    head = media.split(b"\n", 3)
    width, height = map(int, head[1].split())
    if head[0] != b"P6" or head[2] != b"255" or len(head[3]) != width * height * 3:
        raise ValueError("not a whole 8-bit PPM image")
    return np.frombuffer(head[3], dtype=np.uint8).reshape(height, width, 3)


def feature(samples: np.ndarray) -> str:
    """Rows, mean, spread, smallest and largest sample, and the shares of eight bins."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    n, levels = samples.size, np.arange(256)
    mean = int((counts * levels).sum()) / n
    spread = (int((counts * levels * levels).sum()) / n - mean * mean) ** 0.5 if n else 0.0
    seen = np.flatnonzero(counts)
    bins = ",".join(f"{x / n:.4f}" for x in counts.reshape(8, 32).sum(axis=1).tolist())
    return f"rows={samples.shape[0]};mean={mean:.4f};std={spread:.4f};min={seen[0]};max={seen[-1]};bins={bins}"


DESCRIPTOR = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: bytes) -> tuple:
    """Read a stored image and describe what was read."""
    samples = read_back(media)
    back = samples.tobytes()
    sha = sha256(back).hexdigest()
    return sha, len(back), sha, crc32(back[-TAIL:]), len(media), sha256(media).hexdigest(), feature(samples)


def stored(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``media``: the stored form of every payload, in a table in the shared folder."""
    rows = payloads.select(F.col(column).cast("binary").alias("payload")).where("payload is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([store_form(p) for p in dict.fromkeys(b.column(0).to_pylist())], pa.binary())], names=["media"])

    return written(rows.mapInArrow(run, "media binary"), compression="zstd")


def media_store(payloads: DataFrame, column: str = "payload", keep_media: bool = False) -> DataFrame:
    """One row per distinct payload: :data:`DESCRIPTOR`, and the stored bytes as ``media`` if
    they are wanted. Copies meet as small rows in a partial aggregation."""
    names = [d.split()[0] for d in DESCRIPTOR.split(", ")]
    kinds = [pa.int64() if d.endswith("long") else pa.string() for d in DESCRIPTOR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [describe(m) for m in b.column(0).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [()] * len(names)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, *[b.column(0)] * keep_media], names=[*names, *["media"] * keep_media])

    made = stored(payloads, column).mapInArrow(run, DESCRIPTOR + ", media binary" * keep_media)
    rest = [c for c in made.columns if c != "digest"]
    return made.groupBy("digest").agg(*[F.first(c).alias(c) for c in rest])


def resolve(refs: DataFrame, store: DataFrame, key: str | list[str]) -> DataFrame:
    """Left join of references to the store by ``digest``; ``key`` names columns that tell
    references apart, to salt digests that many of them share."""
    return salted_lookup(refs, store, "digest", [key] if isinstance(key, str) else key)


def report(docs: DataFrame) -> DataFrame:
    """Each document as a page with text around one figure, whose payload is the document's text."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    digest = F.sha2(payload_text(F.col("text")), 256)
    html = F.concat(F.lit('<article><h1>page</h1><figure><img src="sha256:'), digest, F.lit('"><figcaption>text of document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("</figcaption></figure><p>end</p></article>"))
    pages = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), html.alias("html"))
    refs = interleave(pages).where("kind = 'media'").select("doc_id", "n_bytes", "digest", "position", "caption")
    store = media_store(rows.select(payload_text(F.col("text")).alias("payload")))
    names = [d.split()[0] for d in DESCRIPTOR.split(", ")][1:]
    return resolve(refs, store, "doc_id").select("doc_id", "n_bytes", *names, "position", "caption")
