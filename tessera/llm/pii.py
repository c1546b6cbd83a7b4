"""Personal data by exact patterns and a character model.

The patterns find e-mail addresses, IP addresses, card and phone numbers in their plain forms. A bidirectional LSTM over
characters with a CRF on top, trained here in numpy from labelled spans, adds the forms that they miss (an address with
blanks round its signs, a number without its plus). Texts are read in windows of WINDOW characters that overlap by half; the
emissions of overlapping windows are averaged, with more weight for what lies further from a window's edge, and each stretch
of windows is decoded once as a whole. A window is read if it holds a digit or an @: every span has one, so no other window
can hold a span. A span that the model adds must have the digits or signs of its kind and whole words at its ends, and
overlap no span of the patterns.

The labelled spans are generated from a fixed seed (forms of the four kinds and look-alikes among made-up words), TRAIN_ROWS
windows of them; the bound is a parameter.

Defined results: a null or empty text has no spans; spans of two kinds that overlap both count (the patterns' own rule), in order
of start, then kind, then end; repeated rows are read each on its own; a very long text is read whole; an empty table gives an
empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
TRAIN_ROWS, EPOCHS, EMBED, HIDDEN, SEED = 1600, 14, 12, 16, 5

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local_chars = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Possessive, and from the first digit of a run on: the same matches as the plain patterns, in linear time.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_trigger = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local_chars:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the plain patterns, by start, then kind."""
    if not _trigger.search(text):
        return []
    found = [("email", *s) for s in emails(text)]
    found += [("ip", *m.span()) for m in _ip.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in _card.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _phone.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- labelled spans -----------------------------------------------------------------------------------------------------

_SYLLABLES = "an en er in on re th ed es ing ou ha ne ti st la le de que ción é è ü ö ä ß ñ ó í ch sch keit eau oi".split()


def _word(r: random.Random) -> str:
    w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    return w.capitalize() if r.random() < 0.1 else w.upper() if r.random() < 0.03 else w


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _latin(r: random.Random, n: int) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def _card_number(r: random.Random) -> str:
    body = r.choice("345") + _number(r, r.choice([13, 14, 14, 14]))
    return next(body + c for c in "0123456789" if luhn(body + c))


def make_item(r: random.Random) -> tuple[str | None, str]:
    """A kind (None: a look-alike) and a form of it."""
    kind = r.choice([*KINDS, *KINDS, None, None, None])
    if kind == "email":
        name = r.choice([_latin(r, r.randint(2, 9)), f"{_latin(r, r.randint(2, 7))}{r.choice('._-+')}{_latin(r, 3)}", f"{_latin(r, r.randint(2, 8))}.{_number(r, 2)}"])
        host = f"{_latin(r, r.randint(3, 8))}{r.choice(['', _number(r, 1)])}.{r.choice(['example.com', 'example.org', 'net', 'co.uk', 'de', 'com'])}"
        if r.random() < 0.35:
            return kind, r.choice([f"{name} @ {host}", f"{name}@ {host}", f"{name} @{host}"])
        return kind, f"{name}@{host}"
    if kind == "ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        return kind, r.choice([".", ".", ".", " . ", "[.]", ". "]).join(parts)
    if kind == "card":
        n = _card_number(r)
        groups = [n[k : k + 4] for k in range(0, len(n), 4)]
        return kind, r.choice(["", "", " ", "-", ".", "  ", "/"]).join(groups)
    if kind == "phone":
        a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
        return kind, r.choice([f"+1 ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+{r.randint(10, 99)}{a}{b}{c}", f"00{r.randint(30, 49)} {a} {b}{c}"])
    y, m, d = r.randint(1900, 2099), r.randint(1, 12), r.randint(1, 28)
    return None, r.choice(
        [f"{y}-{m:02}-{d:02}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", f"{y}", f"{d}:{m:02}", f"${d},{_number(r, 3)}.{_number(r, 2)}", f"v{d}.{m}.{r.randint(0, 9)}", f"{d}.{m}", f"#{_number(r, 6)}", f"{_number(r, r.randint(1, 6))}",
         "".join(r.choice("0123456789abcdef") for _ in range(32)), f"@{_latin(r, 6)}", f"{_number(r, 3)}%", f"{_number(r, 2)}-{_number(r, 2)}", f"({_number(r, 1)})", f"{d} @ {m}", f"{_number(r, r.randint(20, 30))}"]
    )


def make_text(r: random.Random, words: int = 10) -> tuple[str, list[Span]]:
    """Made-up words with items among them, and the labelled spans."""
    text, spans = "", []
    for _ in range(words):
        if r.random() < 0.3:
            kind, form = make_item(r)
            text += r.choice(["", "", "", "(", '"', "tel: ", "= "])
            if kind:
                spans.append((kind, len(text), len(text) + len(form)))
            text += form
        else:
            text += _word(r)
        text += r.choice([" ", " ", " ", " ", ", ", ". ", ".\n", "\n", "; "])
    return text, spans


# --- the model ----------------------------------------------------------------------------------------------------------

LABELS = 1 + 2 * len(KINDS)  # 0: outside; 2k+1: first of kind k; 2k+2: inside kind k
_VOCABULARY = 102


def char_ids(text: str) -> np.ndarray:
    """Printable ASCII has an id for each character; all else is one of six classes. 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ids = np.where((points >= 32) & (points < 127), points - 31, 96)
    for k in np.flatnonzero(ids == 96):
        c = text[k]
        ids[k] = 97 if c == "\n" else 98 if c.isspace() else 99 if c.isupper() else 100 if c.isalpha() else 101 if c.isdigit() else 96
    return ids


def label_ids(n: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for kind, start, end in spans:
        k = KINDS.index(kind)
        y[start:end] = 2 * k + 2
        y[start] = 2 * k + 1
    return y


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm_emissions(p: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False):
    """Emissions (rows, window, labels) of windows of character ids; ``keep`` returns what the gradients need as well."""
    rows, steps = ids.shape
    x = p["embed"][ids]
    both = np.stack([x, x[:, ::-1]])  # 0 reads forwards, 1 backwards
    gates_x = both @ p["wx"][:, None] + p["b"][:, None, None]
    h = np.zeros((2, rows, HIDDEN), x.dtype)
    c = np.zeros_like(h)
    hs, saved = np.empty((steps, 2, rows, HIDDEN), x.dtype), []
    for t in range(steps):
        g = gates_x[:, :, t] + h @ p["wh"]
        i, f, o = _sigmoid(g[..., :HIDDEN]), _sigmoid(g[..., HIDDEN : 2 * HIDDEN]), _sigmoid(g[..., 2 * HIDDEN : 3 * HIDDEN])
        z = np.tanh(g[..., 3 * HIDDEN :])
        new = f * c + i * z
        squashed = np.tanh(new)
        if keep:
            saved.append((i, f, o, z, c, squashed, h))
        c, h = new, o * squashed
        hs[t] = h
    read = np.concatenate([hs[:, 0].transpose(1, 0, 2), hs[::-1, 1].transpose(1, 0, 2)], axis=2)
    out = read @ p["out"] + p["bias"]
    return (out, (both, saved, read)) if keep else out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradients(p: dict[str, np.ndarray], ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log-likelihood of the CRF a window, and its gradients."""
    emit, (both, saved, read) = lstm_emissions(p, ids, keep=True)
    rows, steps, labels = emit.shape
    move = p["move"]
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[:, 0] = emit[:, 0]
    for t in range(1, steps):
        alpha[:, t] = emit[:, t] + _logsumexp(alpha[:, t - 1, :, None] + move, 1)
    for t in range(steps - 2, -1, -1):
        beta[:, t] = _logsumexp(move + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    total = _logsumexp(alpha[:, -1], 1)
    r = np.arange(rows)[:, None]
    gold = emit[r, np.arange(steps), y].sum(1) + move[y[:, :-1], y[:, 1:]].sum(1)
    d_emit = np.exp(alpha + beta - total[:, None, None])
    pairs = np.exp(alpha[:, :-1, :, None] + move + (emit + beta)[:, 1:, None, :] - total[:, None, None, None])
    d_move = pairs.sum((0, 1))
    np.add.at(d_move, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
    d_emit[r, np.arange(steps), y] -= 1
    d_emit /= rows
    g = {"move": d_move / rows, "out": np.tensordot(read, d_emit, ([0, 1], [0, 1])), "bias": d_emit.sum((0, 1))}
    d_read = d_emit @ p["out"].T
    d_h = np.stack([d_read[..., :HIDDEN], d_read[:, ::-1, HIDDEN:]])
    d_gates = np.empty((2, rows, steps, 4 * HIDDEN), emit.dtype)
    back_h, back_c = np.zeros((2, rows, HIDDEN), emit.dtype), np.zeros((2, rows, HIDDEN), emit.dtype)
    g["wh"] = np.zeros_like(p["wh"])
    for t in range(steps - 1, -1, -1):
        i, f, o, z, c, squashed, h = saved[t]
        dh = d_h[:, :, t] + back_h
        dc = back_c + dh * o * (1 - squashed**2)
        d = np.concatenate([dc * z * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - z**2)], axis=2)
        d_gates[:, :, t] = d
        g["wh"] += h.transpose(0, 2, 1) @ d
        back_h, back_c = d @ p["wh"].transpose(0, 2, 1), dc * f
    g["wx"] = np.einsum("krte,krtg->keg", both, d_gates)
    g["b"] = d_gates.sum((1, 2))
    d_both = d_gates @ p["wx"].transpose(0, 2, 1)[:, None]
    g["embed"] = np.zeros_like(p["embed"])
    np.add.at(g["embed"], ids, d_both[0] + d_both[1][:, ::-1])
    return float((total - gold).mean()), g


@lru_cache(maxsize=2)
def train(rows: int = TRAIN_ROWS, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Parameters learnt from ``rows`` labelled windows by Adam; the same for the same arguments."""
    r, rng = random.Random(seed), np.random.default_rng(seed)
    ids, ys = [], []
    while len(ids) < rows:
        text, spans = make_text(r)
        x, y = char_ids(text), label_ids(len(text), spans)
        at = r.randint(0, max(0, len(text) - WINDOW))
        x, y = x[at : at + WINDOW], y[at : at + WINDOW]
        ids.append(np.pad(x, (0, WINDOW - len(x))))
        ys.append(np.pad(y, (0, WINDOW - len(y))))
    ids, ys = np.array(ids), np.array(ys)
    start = lambda *shape: (rng.normal(size=shape) * (0.5 if shape[0] == _VOCABULARY else 1 / np.sqrt(shape[-2]))).astype(np.float32)
    p = {"embed": start(_VOCABULARY, EMBED), "wx": start(2, EMBED, 4 * HIDDEN), "wh": start(2, HIDDEN, 4 * HIDDEN), "b": np.zeros((2, 4 * HIDDEN), np.float32), "out": start(2 * HIDDEN, LABELS), "bias": np.zeros(LABELS, np.float32), "move": np.zeros((LABELS, LABELS), np.float32)}
    p["b"][:, HIDDEN : 2 * HIDDEN] = 1
    first, second, step, batch = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0, 64
    for epoch in range(epochs):
        order = rng.permutation(rows)
        for at in range(0, rows, batch):
            _, g = gradients(p, ids[order[at : at + batch]], ys[order[at : at + batch]])
            step += 1
            rate = 0.015 * (1 - epoch / epochs) + 0.001
            norm = np.sqrt(sum(float((v.astype(np.float64) ** 2).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of stretches (rows, steps, labels) of one length."""
    rows, steps, labels = emit.shape
    score, back = emit[:, 0], np.zeros((steps, rows, labels), np.int8)
    for t in range(1, steps):
        every = score[:, :, None] + move
        back[t] = every.argmax(1)
        score = every.max(1) + emit[:, t]
    out = np.empty((rows, steps), np.int64)
    out[:, -1] = score.argmax(1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[t, np.arange(rows), out[:, t]]
    return out


_WEIGHT = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)[:, None]


def stretches(text: str) -> list[tuple[int, int]]:
    """(first window, windows) of the runs of windows that hold a trigger; window k starts at k * STRIDE."""
    at = np.array([m.start() for m in _trigger.finditer(text)], np.int64)
    if not len(at):
        return []
    windows = np.unique(np.concatenate([at // STRIDE, np.maximum(at // STRIDE - 1, 0)]))
    first = np.flatnonzero(np.r_[True, np.diff(windows) > 1])
    return [(int(windows[a]), int(b - a)) for a, b in zip(first, np.r_[first[1:], len(windows)], strict=True)]


def model_spans(p: dict[str, np.ndarray], texts: list[str]) -> list[list[Span]]:
    """What the model finds in each text, as labelled, before any test."""
    where = [(k, first, n) for k, text in enumerate(texts) for first, n in stretches(text)]
    found: list[list[Span]] = [[] for _ in texts]
    for batch in _batched(where, 2048):
        ids = np.zeros((sum(n for *_, n in batch), WINDOW), np.int64)
        row = 0
        for k, first, n in batch:
            own = char_ids(texts[k][first * STRIDE : (first + n - 1) * STRIDE + WINDOW])
            own = np.pad(own, (0, (n - 1) * STRIDE + WINDOW - len(own)))
            ids[row : row + n] = np.lib.stride_tricks.sliding_window_view(own, WINDOW)[::STRIDE]
            row += n
        emit = np.concatenate([lstm_emissions(p, ids[a : a + 512]) for a in range(0, len(ids), 512)]) * _WEIGHT
        by_length: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        row = 0
        for k, first, n in batch:
            merged, weight = np.zeros(((n - 1) * STRIDE + WINDOW, LABELS), np.float32), np.zeros(((n - 1) * STRIDE + WINDOW, 1), np.float32)
            for w in range(n):
                merged[w * STRIDE : w * STRIDE + WINDOW] += emit[row + w]
                weight[w * STRIDE : w * STRIDE + WINDOW] += _WEIGHT
            by_length.setdefault(n, []).append((k, first * STRIDE, merged / weight))
            row += n
        for group in by_length.values():
            labels = viterbi(np.stack([m for *_, m in group]), p["move"])
            for (k, offset, _), y in zip(group, labels, strict=True):
                y = y[: len(texts[k]) - offset]
                for a in np.flatnonzero(y % 2 == 1):
                    b = a + 1
                    while b < len(y) and y[b] == y[a] + 1:
                        b += 1
                    found[k].append((KINDS[y[a] // 2], offset + int(a), offset + int(b)))
    return found


def _batched(where: list[tuple[int, int, int]], windows: int) -> Iterator[list[tuple[int, int, int]]]:
    batch, n = [], 0
    for x in where:
        if batch and n + x[2] > windows:
            yield batch
            batch, n = [], 0
        batch.append(x)
        n += x[2]
    if batch:
        yield batch


def plausible(kind: str, text: str, start: int, end: int) -> bool:
    """Has a span of the model what its kind must have, and whole words at its ends?"""
    said, digits = text[start:end], _digits(text[start:end])
    if not said or (start and (text[start - 1].isalnum() or text[start - 1] == "@")) or (end < len(text) and (text[end].isalnum() or text[end] == "@")):
        return False
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", said))
    if not all(not c.isalpha() for c in said):
        return False
    if kind == "ip":
        parts = re.findall(r"[0-9]+", said)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and len(said) - len(digits) >= 2


def all_spans(p: dict[str, np.ndarray], texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the patterns, and these and the model's in order."""
    texts = [t or "" for t in texts]
    out = []
    for text, found in zip(texts, model_spans(p, texts), strict=True):
        base = base_spans(text)
        more = [s for s in found if plausible(s[0], text, s[1], s[2]) and all(s[2] <= b[1] or b[2] <= s[1] for b in base)]
        out.append((base, sorted({*base, *more}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame) -> DataFrame:
    """A row for each document: how many spans of each kind the patterns find, their digest, and all spans."""
    model = docs.sparkSession.sparkContext.broadcast(train())  # a fixed number of parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, spans in all_spans(model.value, batch.column(1).to_pylist()):
                kinds = [k for k, *_ in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split(" ")[0] for x in FOUND.split(", ")])

    return documents(docs).mapInArrow(run, FOUND)


def redact_text(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, becomes its (first) kind in brackets."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with the spans in ``text`` replaced; an integer ``n_chars`` is brought up to date."""
    model, at, names, schema = docs.sparkSession.sparkContext.broadcast(train()), docs.columns.index("text"), docs.columns, docs.schema
    counted = names.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            clean = [t if not spans else redact_text(t, spans) for t, (_, spans) in zip(texts, all_spans(model.value, texts), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            if counted is not None:
                old = batch.column(counted).to_pylist()
                columns[counted] = pa.array([o if a is b or a == b else len(b) for o, a, b in zip(old, texts, clean, strict=True)], batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)
