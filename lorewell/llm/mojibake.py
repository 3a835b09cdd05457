"""Problem 2: text decoded with a wrong encoding, found and restored.

A chain is a sequence of (encode, decode) steps that a sound text went through. A multinomial
classifier on hashed byte bigrams is trained in the run on sound tokens of a bounded sample of
the table, on the same tokens garbled by every chain, and on what comes of inverting sound
tokens by chains they never went through. A token's chain is the most probable class among
those that strict decodability leaves: every step back must be decodable, and garbling the
result again must give the token. The chain is believed if it beats "sound",
and if the classifier calls the restored token sound. Characters that replace
lost ones (U+FFFD) prove a wrong decoding by themselves; such tokens are restored as far as
their most probable chain allows.

The unit is a token between ASCII spaces that holds a character beyond ASCII, so that a text
that is garbled in part is judged in parts, and equal tokens of a batch are judged once.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import hashed_sample, out_batch, slices

#: Pages that the classifier is trained on, drawn by a hash of the id; tokens garbled per chain, and sound ones at most.
SAMPLE_PAGES, TOKENS_PER_CHAIN, SOUND_TOKENS = 2000, 500, 6000

BUCKETS = 2048

#: Log-odds that a strictly decodable UTF-8 sequence adds to a chain that began with UTF-8: legacy pages decode anything.
UTF8_ODDS = 4.0

#: A token of one or two characters must be this many times as frequent as another to show that the other is garbled.
SHORT_TIMES = 20

_WEB1252 = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)}
_WEB1252_BACK = {c: b for b, c in _WEB1252.items()}


def _encode(text: str, codec: str) -> bytes:
    if codec == "web1252":  # windows-1252 whose five undefined bytes pass through
        try:
            return text.encode("cp1252")
        except UnicodeEncodeError:
            pass
        try:
            return bytes(_WEB1252_BACK[c] for c in text)
        except KeyError as e:
            raise UnicodeEncodeError(codec, text, 0, 1, "not in the code page") from e
    return text.encode(codec)


def _decode(raw: bytes, codec: str, errors: str = "strict") -> str:
    if codec == "web1252":
        try:
            return raw.decode("cp1252")
        except UnicodeDecodeError:
            return "".join(map(_WEB1252.__getitem__, raw))
    return raw.decode(codec, errors)


#: name -> steps (encoded as, decoded as), first step first.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf-8 as latin-1": (("utf-8", "latin-1"),),
    "utf-8 as cp1252": (("utf-8", "web1252"),),
    "utf-8 as cp1251": (("utf-8", "cp1251"),),
    "utf-8 as cp437": (("utf-8", "cp437"),),
    "utf-8 as cp850": (("utf-8", "cp850"),),
    "utf-8 as mac-roman": (("utf-8", "mac-roman"),),
    "utf-8 as gb18030": (("utf-8", "gb18030"),),
    "utf-8 as gbk": (("utf-8", "gbk"),),
    "utf-8 as big5": (("utf-8", "big5"),),
    "utf-8 as cp932": (("utf-8", "cp932"),),
    "gbk as latin-1": (("gbk", "latin-1"),),
    "gbk as cp1252": (("gbk", "web1252"),),
    "gbk as utf-8": (("gbk", "utf-8"),),
    "cp1252 as utf-8": (("cp1252", "utf-8"),),
    "cp1252 as cp1251": (("cp1252", "cp1251"),),
    "cp1252 as gbk": (("cp1252", "gbk"),),
    "cp1252 as cp437": (("cp1252", "cp437"),),
    "cp1252 as mac-roman": (("cp1252", "mac-roman"),),
    "twice utf-8 as latin-1": (("utf-8", "latin-1"),) * 2,
    "twice utf-8 as cp1252": (("utf-8", "web1252"),) * 2,
    "utf-8 as latin-1, then as cp1252": (("utf-8", "latin-1"), ("utf-8", "web1252")),
    "utf-8 as cp1252, then as latin-1": (("utf-8", "web1252"), ("utf-8", "latin-1")),
}
#: BROKEN is what comes of inverting a sound token; only restored tokens can be it.
SOUND, BROKEN = "sound", "broken"
CLASSES = [SOUND, *CHAINS, BROKEN]

_TOKEN = re.compile(r"[^ \t\n]*[^\x00-\x7f][^ \t\n]*")
_LOST = re.compile("[\ufffd\ue000-\uf8ff\x80-\x84\x86-\x9f]")


def garble(text: str, chain: str) -> str | None:
    """The text after the chain, lost characters as U+FFFD; None if it cannot be encoded or does not change."""
    out = text
    for enc, dec in CHAINS[chain]:
        try:
            out = _decode(_encode(out, enc), dec, "replace")
        except UnicodeEncodeError:
            return None
    return out if out != text else None


def invert(token: str, chain: str) -> str | None:
    """The token's original under the chain: strictly decodable in each step, garbled again to the same token; else None."""
    if chain.endswith("as utf-8"):
        return None  # these always lose characters
    out = token
    try:
        for enc, dec in reversed(CHAINS[chain]):
            out = _decode(_encode(out, dec), enc)
    except (UnicodeDecodeError, UnicodeEncodeError):
        return None
    return out if not out.isascii() and not _LOST.search(out) and garble(out, chain) == token else None


def _salvage(token: str, chain: str) -> str | None:
    """As much of the original as can be had of a token that lost characters: undecodable stretches come out as U+FFFD."""
    if chain.endswith("as utf-8"):
        return None
    out = token
    for enc, dec in reversed(CHAINS[chain]):
        raw = b""
        for ch in out:
            try:
                raw += b"\xff" if ch == "�" else _encode(ch, dec)
            except UnicodeEncodeError:
                raw += b"\xff"
        out = _decode(raw, enc, "replace")
    return re.sub("�+", "�", out) if out.count("�") * 2 < max(len(out), 1) else None


def features(tokens: list[str]) -> np.ndarray:
    """Hashed counts of the byte bigrams of each token (with its ends), as square roots scaled to length 1."""
    raw = [b"\x02" + t.encode("utf-8", "surrogatepass") + b"\x03" for t in tokens]
    n = np.array([len(r) for r in raw], np.int64)
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(raw)), n)
    pair = (b[:-1] << 8 | b[1:]) if len(b) else b
    inside = row[1:] == row[:-1]
    bucket = (pair * np.uint32(2654435761) >> np.uint32(21)).astype(np.int64)
    x = np.bincount((row[:-1] * BUCKETS + bucket)[inside], minlength=len(raw) * BUCKETS).astype(np.float32).reshape(len(raw), BUCKETS)
    np.sqrt(x, out=x)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


@dataclass
class Classifier:
    weights: np.ndarray  # BUCKETS x classes
    bias: np.ndarray

    def log_odds(self, tokens: list[str]) -> np.ndarray:
        """Each class's log-odds against "sound"."""
        parts = [features(tokens[lo : lo + 1000]) @ self.weights + self.bias for lo in range(0, len(tokens), 1000)]
        z = np.concatenate(parts) if parts else np.zeros((0, len(CLASSES)), np.float32)
        return z - z[:, :1]


_PRIOR = np.array([UTF8_ODDS if c.startswith(("utf-8", "twice")) else 0.0 for c in CLASSES], np.float32)


def sound_tokens(tokens: list[str]) -> Counter:
    """Tokens that may be taken for sound, with their counts.

    Left out are ASCII tokens, those that lost characters, those that a UTF-8 chain inverts, and
    those that come of garbling a more frequent token (SHORT_TIMES as frequent, if that has one or two characters).
    """
    utf8 = [c for c in CHAINS if c.startswith(("utf-8", "twice"))]
    kept = Counter({t: n for t, n in Counter(tokens).items() if not t.isascii() and not _LOST.search(t) and not any(invert(t, c) for c in utf8)})
    other = [c for c in CHAINS if c not in utf8 and not c.endswith("as utf-8")]
    made = {(t, g) for t in kept for c in other if (g := garble(t, c)) in kept}
    bad = {g for s, g in made if kept[s] > kept[g] * (1 if len(s) > 2 else SHORT_TIMES)}
    return Counter({t: n for t, n in kept.items() if t not in bad})


def _scrambled(token: str, rng: np.random.Generator) -> str:
    """The token with other characters of any script, up to U+2FFF, in the place of those beyond ASCII."""
    return "".join(c if c.isascii() else chr(rng.integers(0x250, 0x3000)) for c in token)


def training_set(sound: Counter, per_chain: int = TOKENS_PER_CHAIN, most: int = SOUND_TOKENS, seed: int = 5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(tokens, class numbers, weights): sound tokens, some garbled by each chain, and sound ones wrongly inverted or scrambled.

    Half the tokens garbled per chain are the most frequent ones, the others are drawn evenly. The
    sound tokens together weigh as much as all others, each by the root of its count.
    """
    rng = np.random.default_rng(seed)
    ranked = sorted(sound, key=lambda t: (-sound[t], t))
    shuffled = [ranked[i] for i in rng.permutation(len(ranked))]
    # a long token gives a shorter stretch as well, since garbling may touch only a part
    shuffled += [s for t in shuffled if len(t) > 20 and not (s := t[: 1 + int(rng.integers(12))]).isascii()]
    kept = list(itertools.islice(dict.fromkeys([*ranked[: most // 2], *shuffled]), most))
    out, y, w = list(kept), [0] * len(kept), [float(sound.get(t, 1)) ** 0.5 for t in kept]

    def add(k: int, made: Iterator[str], n: int) -> None:
        seen: dict[str, None] = {}
        for g in made:
            seen[g] = None
            if len(seen) == n:
                break
        got = list(seen)
        out.extend(got)
        y.extend([k] * len(got))
        w.extend([1.0] * len(got))

    known = set(sound)
    for k, chain in enumerate(CHAINS, 1):
        for source in (ranked, shuffled):
            add(k, (g for t in source if (g := garble(t, chain)) is not None and not g.isascii() and g not in known), per_chain // 2)
        source = [shuffled[i] for i in rng.permutation(len(shuffled))]
        add(len(CHAINS) + 1, (b for t in source if (b := invert(t, chain)) is not None and b not in known), per_chain // 3)
    add(len(CHAINS) + 1, (_scrambled(t, rng) for t in shuffled), 2 * per_chain)
    y, w = np.array(y, np.int64), np.array(w, np.float32)
    for k in range(len(CLASSES)):
        share = 0.5 if k == 0 else 0.5 / (len(CLASSES) - 1)
        w[y == k] *= share * len(y) / max(w[y == k].sum(), 1e-9)
    return out, y, w


def _softmax_regression(texts: list[str], y: np.ndarray, weight: np.ndarray, rounds: int, rate: float, seed: int) -> Classifier:
    """Adam on mini-batches."""
    m = len(CLASSES)
    w, b = np.zeros((BUCKETS, m), np.float32), np.zeros(m, np.float32)
    x = features(texts)
    rng = np.random.default_rng(seed)
    m1, m2, step = np.zeros_like(w), np.zeros_like(w), 0
    for r in range(rounds):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 512):
            at = order[lo : lo + 512]
            z = x[at] @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p *= weight[at, None]
            g = x[at].T @ p / len(at) + 1e-6 * w
            step += 1
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.999 * m2 + 0.001 * g * g
            now = rate * (1 - 0.8 * r / rounds)
            w = w - now * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            b = b - now * p.mean(axis=0)
    return Classifier(w, b)


def train(tokens: list[str], rounds: int = 9, rate: float = 0.06, seed: int = 3) -> Classifier:
    """The classifier. Without tokens it calls all things sound.

    Trained twice: what the first classifier finds garbled among the tokens taken for sound, unless
    more frequent than what it would be restored to, is left out of the second's training.
    """
    sound = sound_tokens(tokens)
    if not sound:
        return Classifier(np.zeros((BUCKETS, len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32))
    first = _softmax_regression(*training_set(sound, TOKENS_PER_CHAIN // 4), max(rounds // 2, 1), rate, seed)
    for t, (_, back, _) in judge(list(sound), first).items():
        if sound[t] <= max(2, sound[back]):
            del sound[t]
    model = _softmax_regression(*training_set(sound), rounds, rate, seed)
    return model


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text) if text and not text.isascii() else []


def _ranked(z: np.ndarray, token: str, last: int) -> tuple[int, str | None]:
    """The most probable of the first `last` classes that strict decodability leaves, and the token inverted by it."""
    c = 0
    for c in np.argsort(-z[:last], kind="stable"):
        if CLASSES[c] in (SOUND, BROKEN):
            break
        if (back := invert(token, CLASSES[c])) is not None:
            return int(c), back
    return int(c), None


def judge(tokens: list[str], model: Classifier) -> dict[str, tuple[str, str | None, float]]:
    """Affected tokens: token -> (chain, restored text or None, log-odds of the chain against "sound").

    A token with U+FFFD is always affected. C1 and private-use characters keep a token from being
    inverted in full; it is affected if its most probable class is a chain.
    """
    z = model.log_odds(tokens)
    n = len(CLASSES)
    out: dict[str, tuple[str, str | None, float]] = {}
    asked: list[tuple[str, int, str]] = []
    odds = (z + _PRIOR)[:, 1 : n - 1].max(axis=1, initial=-np.inf)
    for i in np.flatnonzero((odds > 0) | np.array(["\ufffd" in t for t in tokens], bool)):
        t = tokens[i]
        c, back = _ranked(z[i] + _PRIOR, t, n - 1)
        if back is not None:
            asked.append((t, c, back))
        elif _LOST.search(t):
            best = 1 + int(np.argmax(z[i, 1 : n - 1]))
            if "\ufffd" in t or z[i, best] > 0:
                out[t] = (CLASSES[best], _salvage(t, CLASSES[best]), float(z[i, best]))
    again = model.log_odds([back for _, _, back in asked]) + _PRIOR
    at = {t: i for i, t in enumerate(tokens)}
    for (t, c, back), zb in zip(asked, again, strict=True):
        if _ranked(zb, back, n)[0] == 0:
            out[t] = (CLASSES[c], back, float(z[at[t], c]))
    return out


def fit(pages: DataFrame, fields: list[str], key: str, sample_pages: int = SAMPLE_PAGES) -> Classifier:
    sample = hashed_sample(pages.select(key, *fields), key, sample_pages).toArrow()
    return train([t for f in fields for text in sample.column(f).to_pylist() for t in tokens_of(text)])


def repair(pages: DataFrame, fields: tuple[str, ...] = ("text", "title"), key: str = "page_id", model: Classifier | None = None) -> DataFrame:
    """One row per affected field: key, field, chains (distinct, sorted), n_tokens, restored.

    `restored` is the field with every affected token put back; a token whose wording is lost
    stays as it is. Null, empty and pure ASCII fields are never affected.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or fit(pages, list(fields), key))
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            keys = batch.column(key)
            for field in fields:
                texts = batch.column(field).to_pylist()
                per_row = [tokens_of(t) for t in texts]
                bad = judge(list(dict.fromkeys(t for row in per_row for t in row)), held.value)
                hit = [i for i, row in enumerate(per_row) if any(t in bad for t in row)]
                chains = [sorted({bad[t][0] for t in per_row[i] if t in bad}) for i in hit]
                count = [sum(t in bad for t in per_row[i]) for i in hit]
                back = [_TOKEN.sub(lambda m: (bad[m[0]][1] or m[0]) if m[0] in bad else m[0], texts[i]) for i in hit]
                yield out_batch(
                    {
                        key: keys.take(pa.array(hit, pa.int64())),
                        "field": pa.array([field] * len(hit), pa.string()),
                        "chains": pa.array(chains, pa.list_(pa.string())),
                        "n_tokens": pa.array(count, pa.int64()),
                        "restored": pa.array(back, pa.string()),
                    }
                )

    return pages.select(key, *fields).mapInArrow(run, f"`{key}` {kind}, field string, chains array<string>, n_tokens bigint, restored string")


def found(pages: DataFrame) -> DataFrame:
    """(page_id, field) of every text or title that holds wrongly decoded characters."""
    return repair(pages).select("page_id", "field")
