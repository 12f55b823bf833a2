"""Main text of web pages by consensus host paths: pages score their containers, hosts vote, winners are re-extracted.

Pages lie in compressed batches in the shared folder (:mod:`.batches`). A task reads each page's elements, leaves out
furniture (menus, adverts, forms and the like, told by tag, role, class words and link lists), and scores the containers
left by the text that they cover. A container is told by its generalised tag-class path: its tags, classes and ids
from the top, digits as ``#``. The scores, added up by batch, host and path, are votes; Spark adds them up by host and
path and sends each batch the sums for its own hosts, so no page moves and a hot host is a row a batch and path.
Then each batch is read again: of its own paths a page takes the one with most votes at its host and gives the text under
it. Pages without a host, or with none of its paths, go by their own scores.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import each_batch, pack_batches, text_bytes, with_replies
from .common import load, small_batches, table
from .html_tree import CONTAINERS, HEADINGS, MAIN_WORDS, Page, words_of

COVER = 0.9  # a container with this share of a page's text covers it
OWN_MARK = 1.5  # how much more an article, main or content container counts
SURE = 2000  # characters from which on a page has a whole vote
VOTES = 1000
_HOST = re.compile(r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    found = _HOST.match(url.strip()) if url else None
    return found.group(1).lower() if found else ""


class Containers:
    """A page's candidate containers by generalised path: elements, score and whether the path is the page's own best."""

    def __init__(self, source: str):
        self.page = page = Page(source)
        n = len(page.tag)
        good, depth = [0] * n, [0] * n
        for e, text, linked in page.blocks:
            good[e] += len(text) - linked
        for e in range(n - 1, 0, -1):
            good[page.parent[e]] += good[e]
        for e in range(1, n):
            depth[e] = depth[page.parent[e]] + 1
        self.total, self.good = good[0], good
        self.elements: dict[bytes, list[int]] = {b"": [0]}
        for e in range(1, n):
            if page.tag[e] in CONTAINERS and not page.dropped[e]:
                self.elements.setdefault(page.path[e], []).append(e)
        self.score: dict[bytes, float] = {}
        deepest = max(depth) + 1
        for path, found in self.elements.items():
            first = found[0]
            if len(found) > 1 and "." not in page.step[first] and "#" not in page.step[first]:
                found = self.elements[path] = [max(found, key=good.__getitem__)]  # nothing tells these apart
            cover = sum(good[e] for e in found) / self.total if self.total else 0.0
            own = page.tag[first] in ("article", "main") or bool(MAIN_WORDS & words_of(" ".join(page.step[first].replace("#", ".").split(".")[1:])))
            self.score[path] = min(1.0, cover / COVER) * (OWN_MARK if own else 1.0) * (1 + 0.2 * depth[first] / deepest if cover >= COVER else 1.0)

    def votes(self) -> dict[bytes, int]:
        """Votes of the page for each of its paths, many or none."""
        best = max(self.score.values())
        weight = VOTES * min(self.total, SURE) / SURE
        return {p: int(weight * (s / best) ** 4) if best else 0 for p, s in self.score.items()}

    def winner(self, sums: dict[bytes, int]) -> bytes:
        """The path with most votes; among equals the one of the best own score, then the first on the page."""
        return max(self.score, key=lambda p: (sums.get(p, 0), self.score[p]))

    def _under(self, elements: list[int]) -> list[int]:
        """Numbers of the blocks under some elements."""
        page, inside = self.page, [False] * len(self.page.tag)
        for e in elements:
            inside[e] = True
        for e in range(1, len(inside)):
            inside[e] = inside[e] or inside[page.parent[e]]
        return [i for i, b in enumerate(page.blocks) if inside[b[0]]]

    def text(self, path: bytes) -> str:
        """The blocks under a path, one a line, and the headings that stand alone beside its only element."""
        page, found = self.page, self.elements[path]
        chosen = self._under(found)
        if len(found) == 1 and chosen:
            blocks = [0] * len(page.tag)
            for e, _, _ in page.blocks:
                blocks[e] += 1
            for e in range(len(blocks) - 1, 0, -1):
                blocks[page.parent[e]] += blocks[e]
            top = found[0]
            while top > 0 and page.tag[top] != "body" and blocks[top] == len(chosen):
                top = page.parent[top]
            if top > 0 and page.tag[top] != "body":
                more = self._under([top])
                if {page.tag[page.blocks[i][0]] for i in set(more).difference(chosen)} <= HEADINGS:
                    chosen = more
        return "\n".join(page.blocks[i][1] for i in chosen)

    def name(self, path: bytes) -> str:
        """A path for readers."""
        e, steps = self.elements[path][0], []
        while e > 0:
            steps.append(self.page.step[e])
            e = self.page.parent[e]
        return " > ".join(reversed(steps))


def _pages(ends: np.ndarray, buf: np.ndarray):
    begin = 0
    for end in ends.tolist():
        yield Containers(buf[begin:end].tobytes().decode("utf-8", "replace"))
        begin = end


def _vote(batch_id, meta, ends, buf):
    import pyarrow as pa

    sums: dict[tuple[str, bytes], int] = {}
    for host, page in zip(meta.column("host").to_pylist(), _pages(ends, buf), strict=True):
        if host:
            for path, n in page.votes().items():
                sums[host, path] = sums.get((host, path), 0) + n
    return pa.table(
        {
            "batch_id": pa.array([batch_id] * len(sums), pa.int64()),
            "host": pa.array([h for h, _ in sums], pa.string()),
            "path": pa.array([p for _, p in sums], pa.binary()),
            "votes": pa.array(list(sums.values()), pa.int64()),
        }
    )


def _extract(batch_id, meta, ends, buf, replies):
    import pyarrow as pa

    sums: dict[str, dict[bytes, int]] = {}
    for host, path, n in zip(*(replies.column(c).to_pylist() for c in ("host", "path", "votes")), strict=True):
        sums.setdefault(host, {})[path] = n
    texts, paths = [], []
    for host, page in zip(meta.column("host").to_pylist(), _pages(ends, buf), strict=True):
        path = page.winner(sums.get(host, {}))
        texts.append(page.text(path))
        paths.append(page.name(path))
    kept = [c for c in meta.schema.names if c != "host"]
    return pa.table({c: meta.column(c) for c in kept} | {"text": pa.array(texts, pa.large_string() if sum(map(len, texts)) > 1 << 29 else pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "path": pa.array(paths, pa.string())})


def host_votes(pages: DataFrame) -> DataFrame:
    """(batch_id, host, path, votes): for each batch of pages its hosts' sums, over all batches."""
    asked = table(pages.mapInArrow(each_batch(_vote), "batch_id long, host string, path binary, votes long"), "votes")
    sums = asked.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return asked.select("batch_id", "host", "path").join(sums, ["host", "path"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col``, ``url_col``, text, n_chars (code points) and path, the container's.

    Null html is empty and gives an empty text, as does a page of furniture only. Pages without a host go by themselves.
    Every row is a page, repeated and null ids included, and repeats vote each time. Blocks are parts between block
    elements' tags; a line break is white space. A very long page is a batch alone. Extra columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    host = F.udf(host_of, "string", useArrow=True)(F.col(url_col).cast("string"))
    types = dict(pages.select(id_col, url_col).dtypes)
    texts = pack_batches(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), text_bytes(F.col(html_col).cast("string"))))
    out = with_replies(texts, host_votes(texts), _extract, f"id {types[id_col]}, url {types[url_col]}, text string, n_chars long, path string")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(load(spark, sf_dir, "pages"))
