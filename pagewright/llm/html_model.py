"""A recurrent labeller of blocks: a bidirectional LSTM in numpy over the leaf sequence of a page.

A block is read as a vector of its tag path (tags, classes, ids, hashed), one of its words (hashed) and a few measures;
forward and backward states let every label depend on the whole page. It is trained here on pages that a generator makes
up: varied templates, with what is main text known by construction.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np

from pagewright.llm.html_blocks import Block, blocks

PATH, WORDS, MEASURES, HIDDEN = 256, 64, 6, 16
DIM = PATH + WORDS + MEASURES


def _hash(x: str, n: int) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass")) % n


class Reader:
    """Vectors of blocks; keeps the hashes of words and the vectors of paths that it has seen."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        v = self.paths.get(path)
        if v is None:
            v = np.zeros(PATH, np.float32)
            for x in path:
                v[_hash("p" + x, PATH)] = 1
            if path:
                tags = [x for x in path if x[0] != "."]
                v[_hash("l" + tags[-1], PATH)] += 1
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = v
        return v

    def vectors(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), DIM), np.float32)
        if len(self.words) > 500_000:
            self.words.clear()
        for k, b in enumerate(page):
            out[k, :PATH] = self.path(b.path)
            words = b.text.lower().split(" ")
            known = self.words
            marks = [known[w] if w in known else known.setdefault(w, _hash(w, WORDS)) for w in words]
            out[k, PATH : PATH + WORDS] = np.bincount(marks, minlength=WORDS) / len(words)
            n = len(b.text)
            out[k, PATH + WORDS :] = (np.log1p(n) / 5, min(1.0, b.linked / n), b.text[-1] in ".!?:;…\"'", k / len(page), len(b.path) / 8, np.log1p(len(words)) / 4)
        return out


@dataclass
class Model:
    """Both directions' input weights, recurrent weights and biases, and the output layer."""

    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    v: np.ndarray
    c: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.b, self.v, self.c]


def _fresh(rng: np.random.Generator) -> Model:
    h = HIDDEN
    bias = np.zeros(4 * h, np.float32)
    bias[h : 2 * h] = 1
    draw = lambda *s: (rng.standard_normal(s) * (1 / np.sqrt(s[0]))).astype(np.float32)
    return Model([draw(DIM, 4 * h) * 2 for _ in range(2)], [draw(h, 4 * h) for _ in range(2)], [bias.copy() for _ in range(2)], draw(2 * h, 1), np.zeros(1, np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), n.max(), DIM), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)] = p
    return x, np.arange(n.max()) < n[:, None]


def _pass(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool):
    """States of one direction over (pages, steps); padding keeps the state."""
    h, n, steps = HIDDEN, x.shape[0], x.shape[1]
    xw = x @ w + b
    hs, cs, trail = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
    out = np.zeros((n, steps, h), np.float32)
    for t in range(steps):
        z = xw[:, t] + hs @ u
        i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
        c = f * cs + i * g
        tc = np.tanh(c)
        m = mask[:, t : t + 1]
        if keep:
            trail.append((i, f, o, g, cs, tc, hs, m))
        cs, hs = np.where(m, c, cs), np.where(m, o * tc, hs)
        out[:, t] = hs
    return out, trail


def _logits(model: Model, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    # the backward direction reads each page's steps reversed; padding stays in front and keeps the first state
    ahead, t0 = _pass(x, mask, model.w[0], model.u[0], model.b[0], keep)
    back, t1 = _pass(x[:, ::-1], mask[:, ::-1], model.w[1], model.u[1], model.b[1], keep)
    both = np.concatenate([ahead, back[:, ::-1]], axis=2)
    return (both @ model.v)[..., 0] + model.c, both, (t0, t1)


def _back(x: np.ndarray, trail: list, w: np.ndarray, u: np.ndarray, dout: np.ndarray):
    """Gradients of one direction from those of its states."""
    h = HIDDEN
    du, dz_all = np.zeros_like(u), np.zeros((x.shape[0], x.shape[1], 4 * h), np.float32)
    dh, dc = np.zeros((x.shape[0], h), np.float32), np.zeros((x.shape[0], h), np.float32)
    for t in range(x.shape[1] - 1, -1, -1):
        i, f, o, g, c0, tc, h0, m = trail[t]
        dh = dh + dout[:, t]
        d = np.where(m, dh, 0)
        dct = np.where(m, dc, 0) + d * o * (1 - tc * tc)
        dz = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), d * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
        dz_all[:, t] = dz
        du += h0.T @ dz
        dh = np.where(m, dz @ u.T, dh)
        dc = np.where(m, dct * f, dc)
    flat = dz_all.reshape(-1, 4 * h)
    return x.reshape(-1, DIM).T @ flat, du, flat.sum(0)


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, batch: int = 24, rate: float = 0.01, seed: int = 11) -> Model:
    """Adam on the logistic loss of all blocks of (vectors, labels); the same pages give the same model."""
    rng = np.random.default_rng(seed)
    model = _fresh(rng)
    params = model.params()
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        for k in range(0, len(order), batch):
            some = sorted((pages[i] for i in order[k : k + batch]), key=lambda p: len(p[0]))
            x, mask = _padded([p[0] for p in some])
            y = np.zeros(mask.shape, np.float32)
            for r, p in enumerate(some):
                y[r, : len(p[1])] = p[1]
            z, both, (t0, t1) = _logits(model, x, mask, True)
            dz = np.where(mask, _sigmoid(z) - y, 0).astype(np.float32)[..., None] / mask.sum()
            dv, dboth = both.reshape(-1, 2 * HIDDEN).T @ dz.reshape(-1, 1), dz @ model.v.T
            gw0, gu0, gb0 = _back(x, t0, model.w[0], model.u[0], dboth[..., :HIDDEN])
            gw1, gu1, gb1 = _back(x[:, ::-1], t1, model.w[1], model.u[1], dboth[:, ::-1, HIDDEN:])
            step += 1
            for j, g in enumerate((gw0, gw1, gu0, gu1, gb0, gb1, dv, dz.sum(axis=(0, 1)))):
                g = np.clip(g, -1, 1)
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                params[j] -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return model


def label(model: Model, reader: Reader, pages: list[list[Block]], most: int = 20_000) -> list[np.ndarray]:
    """Whether each block of each page is main text. Pages of like length are read together, about `most` blocks at a time."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= most:
            end += 1
        some = order[at:end]
        x, mask = _padded([reader.vectors(pages[k]) for k in some])
        z = _logits(model, x, mask)[0]
        for r, k in enumerate(some):
            out[k] = z[r, : len(pages[k])] > 0
        at = end
    return out


#: What the made-up pages call their parts.
MAIN = ("article", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "div.story", "section.post-body", "div#content", "div#main", "div.post-entry", "div.body-text", "div.main-content", "div.page-content", "section.article", "div.text")
OTHER = ("nav", "header", "footer", "aside", "div.ad", "div.ads", "div.advert", "div.banner", "div.promo", "div.sponsored", "div.cookie-notice", "div.notice", "div.consent", "div.sidebar", "div.widget", "ul.menu", "div.navbar", "div.breadcrumb", "div.share", "div.social", "div.related", "div.newsletter", "div.subscribe", "section.comments", "div#comments", "div.comment", "div.login", "form", "div#footer", "div#header", "div#sidebar", "div.popup", "div.alert", "aside.advert", "div.advertisement", "section#comments", "ol.comment-list", "div.respond", "div.replies", "div.topbar", "div.cookie-banner", "div.right-col", "div.teaser", "div.tags")
LICENCES = ("Licensed under the Apache License, Version 2.0.", "This work is licensed under CC BY 4.0.", "Write to the editors if you find a mistake.")
SAYINGS = ("We use cookies to improve your experience.", "Accept all cookies", "Sign up for our newsletter", "Subscribe now", "Advertisement", "Sponsored content", "Share this", "Related articles", "All rights reserved.", "Privacy policy", "Log in", "Leave a comment", "Reply", "Read more", "Home", "Contact", "About", "Search", "© 2024 example")


#: Headings and lines of promotion that stands among main text without a telling name.
PROMOTIONS = ("Newsletter", "Related articles", "You may also like", "Share this article", "Subscribe", "More from us", "Advertisement", "Comments", "Leave a reply", "Follow us", "Most read", "Tags", "Recommended for you")
LINES = ("Get our best stories in your inbox every week.", "Enter your email address to sign up.", "Join thousands of readers and never miss an update.", "Follow us on social media for more.", "Buy now and save with this offer.", "Great post, thanks for sharing!", "You need to log in to reply.", "Click here to learn more.")
#: Common words, so that these don't tell anything by themselves.
COMMON = (
    "the of and to in is it that was for on are with as they be at one have this from or had by but some what there we can out other were all your when up use how said an each which do their time if will way about "
    "many then them would like so these her long make see him two has look more day could go come did my no most who over know water than call first people may down side been now find our you his new work part take place made live where after back little only year came show every good give under name very through just form great think say help low line before turn cause same mean differ move right old too does tell set three want air well also play small end put home read hand port large"
).split()
#: Junk and separators.
SIGNS = ("~~", "==", "++", "^^", "//", "::", "--", "|")


def made_up(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks, whether it is main text.

    Main text stands in a telling wrapper or in ones without name, as paragraphs, bare divisions, spans in divisions, or one run of
    lines; sections of its own stand among it, and promotion that nothing but its words gives away."""
    syllables = ["".join(rng.choice(list("abcdefghijklmnoprstuvwyzäéñöüß"), 2 + int(rng.integers(2)))) for _ in range(30)]
    natural = rng.random() < 0.35
    coined = lambda: "".join(rng.choice(syllables, 1 + int(rng.integers(4))))
    word = lambda: COMMON[int(rng.integers(len(COMMON)))] if natural and rng.random() < 0.8 else coined()

    def sentence(n: int) -> str:
        w = [word() for _ in range(max(1, n))]
        w[0] = w[0].capitalize()
        return (" | " if rng.random() < 0.1 else " ").join(w) + "."

    junk = rng.random() < 0.12
    refrain = sentence(int(rng.integers(1, 4))) if rng.random() < 0.12 else ""  # a short line that comes again and again
    style = str(rng.choice(["p", "div", "span", "run"], p=[0.74, 0.13, 0.08, 0.05]))
    paragraph = "div" if style == "div" else "p"

    def prose(sentences: int, main: bool = False) -> str:
        r = rng.random()
        if main and refrain and r < 0.7:
            return refrain
        if r < 0.06:
            return " ".join([word()] * int(rng.integers(2, 60)))
        if r < 0.1:
            return str(rng.choice(LICENCES))
        if r < 0.17:
            return sentence(int(rng.integers(1, 4)))
        if junk:
            return " ".join(word() + SIGNS[int(rng.integers(len(SIGNS)))] * int(rng.integers(1, 3)) for _ in range(int(rng.integers(1, 60))))
        return rng.choice([" ", "\n", "<br>"], p=[0.8, 0.1, 0.1]).join(sentence(int(rng.integers(1, 15))) for _ in range(sentences))

    def box(name: str, inner: str) -> str:
        tag = name.replace("#", ".").split(".")[0]
        attr = f' class="{name.split(".")[1]}"' if "." in name else f' id="{name.split("#")[1]}"' if "#" in name else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    marks: list[bool] = []

    def leaf(tag: str, text: str, main: bool, closed: bool = True) -> str:
        marks.append(main)
        return f"<{tag}>{text}" + (f"</{tag}>" if closed else "")

    link = lambda x: f'<a href="/{coined()}">{x}</a>'

    def other() -> str:
        name, kind = str(rng.choice(OTHER)), rng.integers(4)
        if kind == 0 or name in ("nav", "ul.menu"):
            items = "".join(leaf("li", link(word() if rng.random() < 0.7 else rng.choice(SAYINGS)), False) for _ in range(int(rng.integers(2, 8))))
            return box(name, items if name.startswith(("ul", "ol")) else f"<ul>{items}</ul>")
        if kind == 1:
            marks.append(False)
            return box(name, (rng.choice(SAYINGS) if rng.random() < 0.5 else "&copy; " + coined() + ".org &ndash; ") + " " + prose(int(rng.integers(1, 3))))
        return box(name, "".join(leaf(str(rng.choice(["p", "div", "h3", "h4"])), prose(int(rng.integers(1, 4))) if rng.random() < 0.6 else rng.choice(SAYINGS), False) for _ in range(int(rng.integers(1, 5)))))

    def promotion() -> str:
        out = leaf(str(rng.choice(["h2", "h3", "h4", "p"])), str(rng.choice(PROMOTIONS)), False)
        for _ in range(int(rng.integers(1, 4))):
            if rng.random() < 0.35:
                out += "<ul>" + "".join(leaf("li", link(sentence(int(rng.integers(2, 8)))), False) for _ in range(int(rng.integers(2, 5)))) + "</ul>"
            else:
                out += leaf("p", str(rng.choice(LINES)) + (" " + str(rng.choice(LINES)) if rng.random() < 0.3 else ""), False)
        return box(str(rng.choice(["section", "div", "section." + coined(), "div." + coined()])), out)

    def text(sentences: int) -> str:
        if style == "span":
            return f'<div class="{coined()}">' + leaf("span", prose(sentences, True), True) + "</div>"
        if style == "run":
            return leaf("div", "<br><br>".join(prose(sentences, True) for _ in range(int(rng.integers(2, 5)))), True)
        return leaf(paragraph, ("<b>" if rng.random() < 0.2 else "") + prose(sentences, True) + ("<br>" if rng.random() < 0.2 else ""), True, paragraph == "div" or rng.random() < 0.8)

    head = "".join(other() for _ in range(int(rng.integers(0, 4))))
    inner = leaf("h1", sentence(int(rng.integers(2, 10))), True) if rng.random() < 0.85 else ""
    for _ in range(int(rng.integers(1, 14)) * (3 if refrain and rng.random() < 0.4 else 1)):
        r = rng.random()
        if r < 0.66 or refrain and r < 0.9:
            inner += text(int(rng.integers(1, 7)))
        elif r < 0.73:
            inner += leaf(str(rng.choice(["h2", "h3", "blockquote", "pre", "figcaption", "dd"])), sentence(int(rng.integers(2, 9))), True)
        elif r < 0.79:
            inner += "<ul>" + "".join(leaf("li", sentence(int(rng.integers(1, 9))), True) for _ in range(int(rng.integers(1, 5)))) + "</ul>"
        elif r < 0.83:
            inner += "<table><tr>" + "".join(leaf("td", sentence(int(rng.integers(1, 4))), True) for _ in range(int(rng.integers(1, 5)))) + "</tr></table>"
        elif r < 0.88:
            inner += "<section>" + leaf("h2", sentence(int(rng.integers(1, 6))), True) + "".join(text(int(rng.integers(1, 5))) for _ in range(int(rng.integers(1, 3)))) + "</section>"
        elif r < 0.92:
            inner += promotion()
        elif r < 0.97:
            inner += other()
    r = rng.random()
    if r < 0.55:
        body = box(str(rng.choice(MAIN)), inner)
    elif r < 0.85:
        body = box("article", inner)
    else:
        body = inner
        for _ in range(int(rng.integers(0, 4))):
            body = box(str(rng.choice(["div", "div." + coined(), "div#" + coined(), "section"])), body)
    page = head + body + "".join(other() for _ in range(int(rng.integers(0, 5))))
    if rng.random() < 0.3:
        page = f"<div class='{coined()}'>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{page}</body></html>", marks


def taught(pages: int = 3000, seed: int = 5) -> Model:
    """Trains the model on so many made-up pages."""
    rng, reader = np.random.default_rng(seed), Reader()
    known = []
    for _ in range(pages):
        page, marks = made_up(rng)
        found = blocks(page)
        if len(found) != len(marks):
            raise ValueError("a made-up page has other blocks than were made")
        known.append((reader.vectors(found), np.array(marks, np.float32)))
    return train(known)


SAVED = Path(__file__).with_name("html_model.npz")


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model as `python -m pagewright.llm.html_model` trained and saved it."""
    with np.load(SAVED) as f:
        p = [f[f"p{k}"].astype(np.float32) for k in range(8)]
    return Model(p[0:2], p[2:4], p[4:6], p[6], p[7])


if __name__ == "__main__":
    np.savez_compressed(SAVED, **{f"p{k}": p.astype(np.float16) for k, p in enumerate(taught().params())})
