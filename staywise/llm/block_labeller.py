"""HTML extraction: a bidirectional LSTM labels every leaf block of a page with the whole page in view.

A block is a vector of hashed tag-path names, hashed words and a few shape numbers. Forward and
backward LSTM states over the page's block sequence give its chance of being main text; the
blocks above one half, in order, are the text. The network is numpy only: it is trained in a few
seconds on ``TRAIN_PAGES`` pages composed from paragraphs of a bounded, hash-ordered sample of the
table, laid out with known labels in many kinds of markup, and is then broadcast (its size is
fixed by the constants below).

Cases: a null or empty page, or one without main text, gives an empty text; cut-off markup reaches
to the page's end; pages of any length are labelled whole, in batches of similar length; repeated
rows are labelled one by one; an empty table gives an empty result and needs no training.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import slices
from staywise.llm.html_blocks import Block, blocks
from staywise.session import ship_code

BUCKETS, WIDE, SHAPE, HIDDEN = 2048, 16, 8, 24
SAMPLE_PAGES, TRAIN_PAGES = 128, 480
_MARK = "\ue000"  # a private-use character
_CODES: dict[str, int] = {}


# -- Features ----------------------------------------------------------------------------


def _code(name: str) -> int:
    code = _CODES.get(name)
    if code is None:
        if len(_CODES) > 200_000:
            _CODES.clear()
        code = _CODES[name] = zlib.crc32(name.encode()) % BUCKETS
    return code


def path_codes(path: tuple[str, ...]) -> list[int]:
    tags = [n for n in path if n[0] == "<"]
    near = [f"leaf{''.join(tags[-1:])}", f"leaf{''.join(tags[-2:])}"]
    return [_code(n) for n in (*dict.fromkeys(path), *near)]


def word_codes(text: str) -> list[int]:
    return [_code(w) for w in text.lower().split()]


def shape(block: Block, at: int, n: int) -> tuple[float, ...]:
    import math

    text = block.text
    words = text.count(" ") + 1
    return (
        math.log1p(len(text)) / 5,
        block.linked / len(text),
        math.log1p(words) / 4,
        float(text[-1] in ".!?…"),
        min(1.0, sum(text.count(c) for c in ",.;:") / words),
        at / n,
        (n - 1 - at) / n,
        min(1.0, n / 100),
    )


def _means(table, lists: list[list[int]]):
    """Mean of the table's rows for each list of codes, with what the way back needs."""
    import numpy as np

    counts = np.array([len(x) for x in lists])
    owner = np.repeat(np.arange(len(lists)), counts)
    codes = np.fromiter((c for x in lists for c in x), np.int64, int(counts.sum()))
    share = (1.0 / np.maximum(counts, 1))[owner].astype(np.float32)
    out = np.zeros((len(lists), table.shape[1]), np.float32)
    begins = np.cumsum(counts) - counts
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(table[codes] * share[:, None], begins[full], axis=0)
    return out, (codes, owner, share)


# -- Network -----------------------------------------------------------------------------


def fresh(seed: int) -> dict:
    import numpy as np

    rng = np.random.default_rng(seed)
    size = 2 * WIDE + SHAPE
    net = {"path": rng.normal(0, 0.3, (BUCKETS, WIDE)), "word": rng.normal(0, 0.05, (BUCKETS, WIDE))}
    for way in ("f", "b"):
        net[f"W{way}"] = rng.normal(0, 1 / np.sqrt(size + HIDDEN), (size + HIDDEN, 4 * HIDDEN))
        net[f"c{way}"] = np.zeros(4 * HIDDEN)
        net[f"c{way}"][HIDDEN : 2 * HIDDEN] = 1.0  # remember by default
    net["v"] = rng.normal(0, 0.1, (2 * HIDDEN, 1))
    net["v0"] = np.zeros(1)
    return {k: a.astype(np.float32) for k, a in net.items()}


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(net: dict, way: str, x, mask):
    """States of one direction, time first; padded steps keep the state as it is."""
    import numpy as np

    steps, n = mask.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    order = range(steps) if way == "f" else range(steps - 1, -1, -1)
    states, trail = np.zeros((steps, n, HIDDEN), np.float32), []
    for t in order:
        z = np.concatenate([x[t], h], axis=1)
        gates = z @ net[f"W{way}"] + net[f"c{way}"]
        i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = f * c + i * g
        squashed = np.tanh(new)
        trail.append((t, z, i, f, o, g, c, squashed, m))
        c = m * new + (1 - m) * c
        h = m * o * squashed + (1 - m) * h
        states[t] = h
    return states, trail


def _run_back(net: dict, way: str, trail, d_states, grads: dict, size: int):
    """Gradients of one direction; returns those of its inputs."""
    import numpy as np

    dx = np.zeros((*d_states.shape[:2], size), np.float32)
    dh = dc = np.zeros_like(d_states[0])
    for t, z, i, f, o, g, before, squashed, m in reversed(trail):
        dh = dh + d_states[t]
        own, inner = dh * m, dc * m
        d_new = inner + own * o * (1 - squashed**2)
        d_gates = np.concatenate(
            [d_new * g * i * (1 - i), d_new * before * f * (1 - f), own * squashed * o * (1 - o), d_new * i * (1 - g**2)], axis=1
        )
        grads[f"W{way}"] += z.T @ d_gates
        grads[f"c{way}"] += d_gates.sum(axis=0)
        dz = d_gates @ net[f"W{way}"].T
        dx[t] = dz[:, :size]
        dh = dh * (1 - m) + dz[:, size:]
        dc = dc * (1 - m) + d_new * f
    return dx


def _batch(net: dict, pages: list[list[Block]]):
    """Inputs of several pages, padded: x[steps, pages, size], mask, and the way back to the tables."""
    import numpy as np

    flat = [b for p in pages for b in p]
    paths, path_back = _means(net["path"], [path_codes(b.path) for b in flat])
    words, word_back = _means(net["word"], [word_codes(b.text) for b in flat])
    shapes = np.array([shape(b, k, len(p)) for p in pages for k, b in enumerate(p)], np.float32)
    rows = np.concatenate([paths, words, shapes], axis=1)
    steps = np.concatenate([np.arange(len(p)) for p in pages])
    owner = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    longest = max(len(p) for p in pages)
    x = np.zeros((longest, len(pages), rows.shape[1]), np.float32)
    mask = np.zeros((longest, len(pages)), np.float32)
    x[steps, owner], mask[steps, owner] = rows, 1
    return x, mask, (steps, owner), (path_back, word_back)


def chances(net: dict, pages: list[list[Block]]) -> list:
    """For each page the chance of every block to be main text."""
    import numpy as np

    x, mask, (steps, owner), _ = _batch(net, pages)
    both = np.concatenate([_run(net, "f", x, mask)[0], _run(net, "b", x, mask)[0]], axis=2)
    p = _sigmoid(both @ net["v"] + net["v0"])[..., 0][steps, owner]
    return np.split(p, np.cumsum([len(q) for q in pages])[:-1])


def fit(pages: list[list[Block]], labels: list[list[int]], seed: int = 7, epochs: int = 8, size: int = 32, rate: float = 0.01) -> dict:
    """Train by back-propagation through the pages with Adam."""
    import numpy as np

    net, rng = fresh(seed), random.Random(seed)
    first = {k: np.zeros_like(a) for k, a in net.items()}
    second = {k: np.zeros_like(a) for k, a in net.items()}
    order, step = list(range(len(pages))), 0
    for epoch in range(epochs):
        rng.shuffle(order)
        for k in range(0, len(order), size):
            own = order[k : k + size]
            x, mask, (steps, owner), backs = _batch(net, [pages[j] for j in own])
            y = np.concatenate([np.array(labels[j], np.float32) for j in own])
            (hf, trail_f), (hb, trail_b) = _run(net, "f", x, mask), _run(net, "b", x, mask)
            both = np.concatenate([hf, hb], axis=2)
            p = _sigmoid(both @ net["v"] + net["v0"])[..., 0]
            d = np.zeros_like(p)
            d[steps, owner] = (p[steps, owner] - y) / len(y)
            grads = {name: np.zeros_like(a) for name, a in net.items()}
            grads["v"] = np.einsum("tbh,tb->h", both, d)[:, None]
            grads["v0"] = d.sum(keepdims=True).reshape(1)
            d_both = d[..., None] * net["v"][:, 0]
            dx = _run_back(net, "f", trail_f, d_both[..., :HIDDEN], grads, x.shape[2])
            dx += _run_back(net, "b", trail_b, d_both[..., HIDDEN:], grads, x.shape[2])
            rows = dx[steps, owner]
            for name, (codes, who, share), part in (("path", backs[0], rows[:, :WIDE]), ("word", backs[1], rows[:, WIDE : 2 * WIDE])):
                np.add.at(grads[name], codes, part[who] * share[:, None])
            step += 1
            speed = rate * (1 - epoch / epochs)
            for name in net:
                g = np.clip(grads[name], -1, 1) + 1e-5 * net[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                net[name] -= (speed * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


# -- Training pages ----------------------------------------------------------------------

_MENU = "nav menu navbar navigation breadcrumb topbar links toc".split()
_HEAD = "header masthead banner top branding logo".split()
_FOOT = "footer bottom copyright colophon legal credits".split()
_SIDE = "sidebar side related widget trending recommended popular tags share social".split()
_NOTE = "cookie notice consent alert newsletter subscribe popup modal gdpr paywall message".split()
_ADS = "ad ads advert advertisement sponsored promo banner sponsor".split()
_TALK = "comments comment responses replies discussion disqus reply thread".split()
_MAIN = "content post article entry story main body text page single".split()


def compose(rng: random.Random, paragraphs: list[str]) -> str:
    """A page in random markup; main text carries a mark that ``labelled`` takes off again."""

    def some(low: int, high: int) -> str:
        words = rng.choice(paragraphs).split()
        at = rng.randrange(max(1, len(words) - high))
        return " ".join(words[at : at + rng.randint(low, high)])

    def long() -> str:
        return rng.choice(paragraphs) if rng.random() < 0.8 else some(1, 12)

    def named(names: list[str]) -> str:
        word = rng.choice(names)
        word = rng.choice((word, f"{word}-{rng.choice(('box', 'area', 'wrap', 'list', 'inner'))}", f"site-{word}"))
        return f' {rng.choice(("class", "class", "id"))}="{word}"'

    def boxed(tags: tuple[str, ...], names: list[str], inner: str, sure: bool = False) -> str:
        tag = rng.choice(tags)
        plain = tag not in ("div", "section", "ul", "span") and not sure and rng.random() < 0.6
        return f"<{tag}{'' if plain else named(names)}>{inner}</{tag}>"

    def links(n: int) -> str:
        items = [f'<a href="/{k}">{some(1, 3)}</a>' for k in range(n)]
        kind = rng.random()
        return f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>" if kind < 0.7 else rng.choice((" ", " | ", "")).join(items)

    def menu() -> str:
        return boxed(("nav", "nav", "div"), _MENU, links(rng.randint(2, 9)))

    def note(names: list[str], tags: tuple[str, ...] = ("div", "div", "section", "aside")) -> str:
        inner = long() if rng.random() < 0.5 else some(3, 20)
        return boxed(tags, names, rng.choice((inner, f"<p>{inner}</p>", f"<h3>{some(1, 4)}</h3><p>{inner}</p>", f"{inner}<button>{some(1, 2)}</button>")), sure=True)

    def form() -> str:
        fields = "".join(f"<label>{some(1, 3)}</label><input name=x>" for _ in range(rng.randint(1, 3)))
        more = f"<select><option>{some(1, 2)}</option><option>{some(1, 2)}</option></select>" if rng.random() < 0.3 else ""
        return f"<form action=/s>{rng.choice(('', f'<p>{some(3, 15)}</p>'))}{fields}{more}<button>{some(1, 2)}</button></form>"

    def talk() -> str:
        tag = rng.choice(("div", "li", "article"))
        each = "".join(f"<{tag} class=\"{rng.choice(('comment', 'reply', 'response'))}\"><b>{some(1, 2)}</b><p>{long()}</p></{tag}>" for _ in range(rng.randint(1, 5)))
        each = f"<ul>{each}</ul>" if tag == "li" else each
        return boxed(("section", "div", "div"), _TALK, f"<h2>{some(1, 3)}</h2>{each}", sure=True)

    def side() -> str:
        return boxed(("aside", "aside", "div"), _SIDE, f"<h3>{some(1, 4)}</h3>" + (links(rng.randint(2, 6)) if rng.random() < 0.6 else f"<p>{long()}</p>"))

    def main() -> str:
        mark = lambda text: _MARK + text
        parts = [f"<h1>{mark(some(3, 12))}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 8, 14))):
            text, kind = mark(long()), rng.random()
            if kind < 0.6:
                parts.append(f"<p>{text}</p>" if rng.random() < 0.8 else f"<p><b>{text}<br>")
            elif kind < 0.72:
                parts.append(f"<h2>{mark(some(2, 8))}</h2><p>{text}</p>")
            elif kind < 0.8:
                parts.append(f"<ul><li>{text}</li><li>{mark(some(2, 15))}</li></ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.94:
                parts.append(f"<div>{text}</div>")
            else:
                parts.append(f"<table><tr><td>{mark(some(1, 5))}</td><td>{text}</td></tr></table>")
            if rng.random() < 0.08:
                parts.append(rng.choice((lambda: note(_ADS), side, lambda: note(_NOTE)))())
        inner = "".join(parts)
        kind = rng.random()
        if kind < 0.55:
            inner = f"<article>{inner}</article>"
        elif kind < 0.75:
            inner = f"<main>{inner}</main>"
        else:
            inner = f"<{rng.choice(('div', 'section', 'article', 'main'))}{named(_MAIN)}>{inner}</div>"
        return f"<main>{inner}</main>" if rng.random() < 0.15 else inner

    parts = []
    if rng.random() < 0.85:
        parts.append(menu() if rng.random() < 0.6 else boxed(("header", "header", "div"), _HEAD, f"<p>{some(1, 6)}</p>{menu()}"))
    before = [lambda: note(_ADS), lambda: note(_NOTE), form, side]
    parts += [make() for make in before if rng.random() < 0.4]
    parts.append(main() if rng.random() < 0.96 else "")
    after = [talk, side, lambda: note(_ADS), lambda: note(_NOTE), form]
    parts += [make() for make in after if rng.random() < 0.4]
    if rng.random() < 0.9:
        parts.append(boxed(("footer", "footer", "div"), _FOOT, rng.choice((some(2, 20), f"&copy; {some(1, 3)} &middot; {long()}", f"<p>{long()}</p>", links(3)))))
    page = f"<!DOCTYPE html><html><head><title>{some(2, 9)}</title></head><body>{''.join(parts)}</body></html>"
    return page[: rng.randrange(len(page) // 2, len(page))] if rng.random() < 0.12 else page


def labelled(page: str) -> tuple[list[Block], list[int]]:
    found = blocks(page)
    labels = [int(_MARK in b.text) for b in found]
    for b in found:
        b.text = b.text.replace(_MARK, "").strip() or "."
    return found, labels


def training_pages(paragraphs: list[str], n: int, seed: int) -> tuple[list, list]:
    rng = random.Random(seed)
    pairs = [labelled(compose(rng, paragraphs)) for _ in range(n)]
    pairs = [p for p in pairs if p[0]]
    return [p for p, _ in pairs], [y for _, y in pairs]


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES, n: int = TRAIN_PAGES, seed: int = 7) -> dict:
    """A network for ``pages``: paragraphs come from at most ``sample`` different pages, chosen by hash.

    A share of the hashes that holds about twice as many is collected, so what reaches the
    driver does not grow with the table.
    """
    own = pages.select(F.col(html).cast("string").alias("html")).filter("html is not null")
    every = max(1, own.count() // (2 * sample))
    chosen = own.filter(F.pmod(F.xxhash64("html"), F.lit(every)) == 0).distinct().limit(8 * sample)
    taken = sorted(chosen.collect(), key=lambda r: zlib.crc32(r.html.encode()))[:sample]
    found = [b.text for row in taken for b in blocks(row.html[: 1 << 20]) if len(b.text) >= 40]
    paragraphs = [t[:2000] for t in sorted(set(found))] or ["Some words of a text that stands for any other.", "Another sentence, with a few more words in it."]
    return fit(*training_pages(paragraphs, n, seed), seed=seed)


# -- Extraction --------------------------------------------------------------------------


def main_texts(net: dict, pages: list[str]) -> list[str]:
    """The main text of each page; pages of similar block counts go through the network together."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and stop - at < 256 and len(found[order[stop]]) <= 2 * len(found[order[at]]) + 8 and (stop - at) * len(found[order[stop]]) < 20_000:
            stop += 1
        own = order[at:stop]
        for k, p in zip(own, chances(net, [found[k] for k in own])):
            out[k] = " ".join(b.text for b, c in zip(found[k], p) if c > 0.5)
        at = stop
    return out


def _extract(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    net = shared.value
    for batch in slices(batches, "html", rows=512, max_bytes=8 << 20):
        texts = main_texts(net, [x or "" for x in batch.column("html").to_pylist()])
        kept = [c for c in batch.schema.names if c != "html"]
        columns = [batch.column(c) for c in kept] + [pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*kept, "text"])


def extract(pages: DataFrame, keep: list[str], html: str = "html", net: dict | None = None) -> DataFrame:
    """The columns of ``keep`` and ``text``, a row per page. Without ``net`` one is trained first."""
    spark = pages.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(net or train(pages, html))
    rows = pages.select(*keep, F.col(html).cast("string").alias("html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(partial(_extract, shared=shared), f"{kinds}, text string")
