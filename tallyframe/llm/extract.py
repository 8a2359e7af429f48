"""Main text of web pages as the maximum-scoring subsequence of a page's words and tags.

A page is a sequence of words and tags. Each kind of token has a weight, the log-odds of standing inside or outside the
main text, learned from labelled pages: pages that mark their article themselves (an ``article`` element). Words score
above zero, tags mostly below. One linear scan finds the contiguous run with the highest sum; inside it, elements that
are never main text (menus, forms, scripts, notices, comments by readers) are left out, and the blocks are joined.

The weights come from a bounded number of labelled pages (``train_pages``, in the order of a digest of the url; pages
that share the last url are all taken), the extraction runs over whole pages. Defined cases: null and empty html give empty text; so does a page without a run above
zero. Broken markup (unclosed elements, cut-off pages and references) is read as far as it goes.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import field, fresh, plain_names, short_batches

TRAIN_PAGES = 2000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|<[/A-Za-z!?][^>]*\Z|([^<]+|<)", re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"}
#: Elements that are never main text, and words of class, id or role that say the same.
OUTSIDE = RAW | {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"}
MARKED = re.compile(
    r"(?:ad|ads|advert|adverts|advertisement|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|footer|masthead|"
    r"sidebar|aside|related|share|sharing|social|notice|notices|cookie|cookies|consent|banner|newsletter|subscribe|signup|popup|modal|comment|comments|disqus|"
    r"respond|replies|contentinfo|complementary|search)", re.I,
)
#: Elements that hold the whole page or its main text, whatever their class says.
HOLDERS = {"html", "body", "main", "article"}
#: What a tag costs at most, in words, and how often each kind is taken to have stood inside besides: a tag that the
#: labelled articles happen not to have is no end of an article. The tags of an article itself are.
TAG_COST, UNSEEN = 2.0, 20.0
LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "mfrac", "mi", "mn", "mo", "mrow", "msqrt", "msub", "msup", "mtext", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
SPACES = re.compile(r"\s+")


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind of token, tag name or empty, text) in page order; comments, declarations and raw elements are one token."""
    out = []
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        closing, name, attributes, text = m.groups()
        if text is not None:
            out.append(("word", "", text))
            continue
        if name is None:
            out.append(("!", "", ""))
            continue
        name = name.lower()
        if not closing and name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            out.append((f"<{name}", "", ""))
            continue
        kind = ("/" if closing else "") + name
        if not closing and name not in HOLDERS and any(MARKED.fullmatch(word) for v in LABEL.findall(attributes) for word in "".join(v).split()):
            kind = f"~{name}"
        out.append((kind, name, ""))
    return out


def around_article(seq: list[tuple[str, str, str]]) -> set[int]:
    """The places of the start tags around the article element with the most words; unclosed ones end with their parent."""
    stack: list[tuple[str, int, int]] = []
    words, best, found = 0, 0, set()

    def closed(at: int) -> None:
        nonlocal best, found
        for i in range(len(stack) - 1, at - 1, -1):
            name, _, before = stack[i]
            if name == "article" and words - before > best:
                best, found = words - before, {start for _, start, _ in stack[:i]}
        del stack[at:]

    for i, (kind, name, text) in enumerate(seq):
        if kind == "word":
            words += len(text.split())
        elif name and kind[0] == "/":
            at = next((j for j in range(len(stack) - 1, -1, -1) if stack[j][0] == name), None)
            if at is not None:
                closed(at)
        elif name and name not in VOID:
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            stack.append((name, i, words))
    closed(0)
    return found


def excluded(seq: list[tuple[str, str, str]]) -> list[bool]:
    """Whether each token stands in an element that is never main text; unclosed ones end with their parent."""
    stack: list[tuple[str, bool]] = []
    out, around = [], around_article(seq)
    for i, (kind, name, _) in enumerate(seq):
        inside = bool(stack) and stack[-1][1]
        if name and kind[0] == "/":
            for j in range(len(stack) - 1, -1, -1):
                if stack[j][0] == name:
                    inside = stack[j][1]
                    del stack[j:]
                    break
        elif name and name not in VOID:
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            inside = (bool(stack) and stack[-1][1]) or (i not in around and (kind[0] == "~" or name in OUTSIDE))
            stack.append((name, inside))
        out.append(inside)
    return out


def token_counts(page: str) -> dict[str, tuple[int, int]] | None:
    """(inside, outside) counts of each kind of token of a page that marks its article; None for others."""
    seq = tokens(page)
    opened = next((i for i, t in enumerate(seq) if t[0] == "article"), None)
    closed = next((i for i in range(len(seq) - 1, -1, -1) if seq[i][0] == "/article"), None)
    if opened is None or closed is None or closed <= opened:
        return None
    found: dict[str, list[int]] = {}
    for i, (kind, _, text) in enumerate(seq):
        n = len(text.split()) if kind == "word" else 1
        if n:
            found.setdefault(kind, [0, 0])[0 if opened < i < closed else 1] += n
    return {k: (a, b) for k, (a, b) in found.items()}


def learn_weights(pages: DataFrame, *, html_column: str = "html", order: str = "url", train_pages: int = TRAIN_PAGES) -> dict[str, float]:
    """The weight of each kind of token: word at most 1 and above zero, tags by their log-odds against words, bounded."""
    digest = F.md5(F.coalesce(F.col(order).cast("string"), F.lit("")))
    marked = pages.where(F.contains(F.lower(html_column), F.lit("<article"))).select(F.col(html_column).alias("h"), digest.alias("m"))
    # Only digests are ordered; the pages up to the last of them are read where they lie.
    last = marked.select("m").orderBy("m").limit(train_pages).agg(F.max("m")).first()[0]
    picked = marked.where(F.col("m") <= F.lit(last)).select("h")

    def run(batches):
        for batch in batches:
            total: dict[str, list[int]] = {}
            for page in batch.column(0).to_pylist():
                for kind, (a, b) in (token_counts(page) or {}).items():
                    entry = total.setdefault(kind, [0, 0])
                    entry[0] += a
                    entry[1] += b
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], names=["kind", "a", "b"]
            )

    # Kinds are tag names: few, and only those of the bounded sample.
    counted = picked.mapInArrow(run, "kind string, a long, b long").groupBy("kind").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = {r.kind: (r.a, r.b) for r in counted.collect()}
    word = counts.pop("word", (0, 0))
    prior = math.log((word[0] + 1) / (word[1] + 1))
    weights = {"word": 1.0}
    for kind, (a, b) in counts.items():
        # Against the words: a tag is a plus only where it stands inside more often than words do.
        seen = 0.5 if kind in ("article", "/article") else UNSEEN
        weights[kind] = 4.0 * (math.log((a + seen) / (b + 0.5)) - max(prior, 0.0)) if a + b >= 5 else -1.0
        weights[kind] = min(weights[kind], -0.05) if a > b else min(weights[kind], -1.0)
        if kind not in ("article", "/article"):
            weights[kind] = max(weights[kind], -TAG_COST)
    return weights


def best_run(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run with the highest sum; (0, 0) if none is above zero."""
    best, current, begin, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if current <= 0:
            current, begin = 0.0, i
        current += s
        if current > best:
            best, found = current, (begin, i + 1)
    return found


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    seq = tokens(page)
    out = excluded(seq)
    scores = []
    for (kind, _, text), outside in zip(seq, out, strict=True):
        if outside:
            # What is left out anyway neither adds to a run nor parts it.
            scores.append(0.0 if kind == "word" else -0.05)
        elif kind == "word":
            scores.append(weights["word"] * len(text.split()))
        else:
            scores.append(weights.get(kind, -1.0))
    begin, end = best_run(scores)
    blocks: list[str] = []
    current: list[str] = []
    for (kind, name, text), outside in zip(seq[begin:end], out[begin:end], strict=True):
        if outside:
            continue
        if kind == "word":
            current.append(text)
        elif name == "br":
            current.append(" ")
        elif name and name not in INLINE:
            blocks.append("".join(current))
            current = []
    blocks.append("".join(current))
    clean = (SPACES.sub(" ", html.unescape(b)).strip() for b in blocks)
    return "\n\n".join(b for b in clean if b)


@plain_names
def extract(pages: DataFrame, *, html_column: str = "html", weights: dict[str, float] | None = None, **options) -> tuple[DataFrame, str]:
    """All rows and columns of ``pages`` and the main text, whose column name is returned too."""
    short_batches(pages.sparkSession)
    weights = weights or learn_weights(pages, html_column=html_column, **options)
    kept, out = pages.columns, fresh(pages, "text")

    def run(batches):
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(html_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, out])

    return pages.mapInArrow(run, T.StructType([*[field(pages, c) for c in kept], T.StructField(out, T.StringType())])), out
