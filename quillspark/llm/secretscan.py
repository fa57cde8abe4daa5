"""Operator 13: secrets by three patterns and a linear-chain conditional random field.

The patterns find assignments, access keys and long hexadecimal runs.  The field tags a
text's tokens (runs of letters, digits and ``_+/.-``) as beginning a secret, going on with one, or outside,
from their shape, the words around them, the delimiters between, and what kind of file the
text looks like; the best sequence of tags of the whole text is decoded by Viterbi.
What it tags adds spans of kind ``crf`` wherever no pattern's span lies.

There are no labels of secrets, so the patterns' own matches teach the field: snippets around
them, also with the value drawn anew in other alphabets and with other key words, against
snippets without a match.  So it learns shapes and neighbours rather than the patterns'
words.  Training reads a bounded sample: ``SAMPLE`` snippets of each kind, those of texts with the smallest
digests; snippets with a match are looked for among the ``RARE * SAMPLE`` texts with the smallest digests.
Training is in numpy, weights end as multiples of 1/1024, so scores are exact and decoding doesn't depend on how
texts are batched.  The Viterbi pass runs over blocks of tokens side by side, with each state that a
block may be entered in, and then from block to block: a long text is decoded whole.

Defined cases: null and empty texts have no spans; equal texts have equal spans; spans count in
code points; without any match in the sample nothing is learnt and only the patterns
find; repeated rows stay; other columns stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vector as V
from .common import docs_table, tune_arrow

KINDS = ["assign", "access", "hex", "crf"]
ASSIGN = re.compile(rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEY_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24, "crf": 6}

#: Snippets of each kind to learn from, texts looked at for one with a match, and bytes on both sides of a span.
SAMPLE, RARE, AROUND = 1500, 400, 200
#: Snippets with new values, all told, and of one snippet.
VARIED, MOST_VARIED = 1500, 40
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 64, 0.3, 0.999, 7
B, I, O = 0, 1, 2
NEVER = -1e6
GRAIN = 1024
#: Tokens in a block of the Viterbi pass.
BLOCK = 256

_byte = np.arange(256)
DIGIT = ((_byte >= 48) & (_byte < 58)).astype(np.uint8)
UPPER = ((_byte >= 65) & (_byte < 91)).astype(np.uint8)
LOW = ((_byte >= 97) & (_byte < 123)).astype(np.uint8)
HIGH = (_byte >= 128).astype(np.uint8)
SIGN = np.isin(_byte, [ord(c) for c in "_+/.-"]).astype(np.uint8)
HEX = (DIGIT | ((_byte >= 97) & (_byte < 103))).astype(bool)
ANY_HEX = (HEX | ((_byte >= 65) & (_byte < 71))).astype(np.uint8)
TOKEN = (DIGIT | UPPER | LOW | HIGH | SIGN).astype(bool)
GIVES = np.isin(_byte, [ord(":"), ord("=")]).astype(np.uint8)
QUOTE = np.isin(_byte, [ord('"'), ord("'")]).astype(np.uint8)
LINE = (_byte == 10).astype(np.uint8)
CLASS = (DIGIT + 2 * UPPER + 3 * LOW + 4 * HIGH + 5 * SIGN).astype(np.uint8)

WORD_BITS = 14
#: Where each feature's numbers begin in the table of weights: four words, then smaller ones.
SIZES = [1 << WORD_BITS] * 4 + [1 << 12, 256, 256, 256, 256, 256, 256]
STARTS = np.cumsum([0, *SIZES])
FEATURES, PAD = len(SIZES), int(STARTS[-1])


# --- the patterns ------------------------------------------------------------------------------


def pattern_spans(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, str, int, int, int]]]:
    """For each text the matches (start, kind, end, start and end of the value), in bytes of the whole buffer."""
    out: list[list] = [[] for _ in range(len(offsets) - 1)]
    raw = data.tobytes()
    low, may = V.LOWER[data].tobytes(), set()
    for word in KEY_WORDS:
        at = low.find(word)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            may.add(d)
            at = low.find(word, max(at + 1, int(offsets[d + 1]) - len(word)))  # on with the next text
    for d in may:
        for m in ASSIGN.finditer(raw, int(offsets[d]), int(offsets[d + 1])):
            if len(m[2]) >= LEAST["assign"]:
                out[d].append((m.start(), "assign", m.end(), m.start(2), m.end(2)))
    at = raw.find(b"AKIA")
    while at >= 0:
        d = int(np.searchsorted(offsets, at, "right")) - 1
        m = ACCESS.match(raw, at, int(offsets[d + 1]))
        if m and len(m[0]) >= LEAST["access"]:
            out[d].append((at, "access", m.end(), at, m.end()))
        at = raw.find(b"AKIA", m.end() if m else at + 1)
    starts, ends, doc = V.words(data, offsets, HEX)
    long = np.flatnonzero(ends - starts >= LEAST["hex"])
    for d, a, b in zip(doc[long].tolist(), starts[long].tolist(), ends[long].tolist()):
        out[d].append((a, "hex", b, a, b))
    return [sorted(x, key=lambda s: (s[0], KINDS.index(s[1]))) for x in out]


# --- features ----------------------------------------------------------------------------------


def upto(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])


def file_kind(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0 to 15 for each text: how many of its bytes are digits and signs, and how many give something a value."""
    n = np.maximum(1, np.diff(offsets))
    per = lambda table: np.diff(upto(data, table)[offsets]) / n
    return np.digitize(per(np.maximum(DIGIT, SIGN)), [0.03, 0.08, 0.2]) * 4 + np.digitize(per(GIVES), [0.001, 0.005, 0.02])


def features(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each token, and its (n, FEATURES) rows in the table of weights."""
    starts, ends, doc = V.words(data, offsets, TOKEN)
    n = len(starts)
    if not n:
        return starts, ends, doc, np.zeros((0, FEATURES), np.int32)
    within = lambda table: (s := upto(data, table))[ends] - s[starts]
    length = ends - starts
    digits, upper, low, high, sign = (within(t) for t in (DIGIT, UPPER, LOW, HIGH, SIGN))
    size = np.digitize(length, [2, 3, 6, 10, 16, 24, 40])
    has = (upper > 0) + 2 * (low > 0) + 4 * (digits > 0) + 8 * (sign > 0) + 16 * ((within(ANY_HEX) == length) & (high == 0))
    shape = size * 32 + has
    change = np.zeros(len(data) + 1, np.int64)
    np.cumsum(CLASS[data[1:]] != CLASS[data[:-1]], out=change[1 : len(data)])
    turns = np.digitize(change[ends - 1] - change[starts], [1, 2, 4, 7, 11, 16, 22])
    share = np.digitize(digits / length, [0.01, 0.25, 0.6])
    mixed = (turns * 8 + size) * 4 + share
    first = np.append(True, doc[1:] != doc[:-1])
    last = np.append(first[1:], True)
    before = np.where(first, offsets[doc], np.append(0, ends[:-1]))
    after = np.where(last, offsets[doc + 1], np.append(starts[1:], 0))
    gap = lambda table: ((s := upto(data, table))[starts] - s[before]) > 0
    gives, lines, quoted = gap(GIVES), gap(LINE), gap(QUOTE)
    closed = (after > ends) & (QUOTE[data[np.minimum(ends, len(data) - 1)]] > 0)
    edge = gives + 2 * lines + 4 * quoted + 8 * closed
    lower = V.LOWER[data]
    word = (V.span_hash(lower, starts, ends) >> V.U64(64 - WORD_BITS)).astype(np.int64)

    def away(x: np.ndarray, by: int, none: int) -> np.ndarray:
        """The value of the token ``by`` places on in the same text."""
        out = np.full(n, none, np.int64)
        to = np.arange(max(0, -by), min(n, n - by))
        ok = to[doc[to] == doc[to + by]]
        out[ok] = x[ok + by]
        return out

    head = (V.span_hash(lower, starts, np.minimum(ends, starts + 4)) >> V.U64(52)).astype(np.int64)
    cols = [word, away(word, -1, 0), away(word, 1, 0), away(word, -2, 0), head, shape, mixed, edge * 16 + np.minimum(length // 3, 15), away(shape, -1, 0), away(shape, 1, 0), kind[doc] * 16 + size * 2 + (digits > 0)]
    return starts, ends, doc, (np.stack(cols, 1) + STARTS[:-1]).astype(np.int32)


# --- the field ---------------------------------------------------------------------------------


def viterbi(emit: np.ndarray, first: np.ndarray, step: np.ndarray, start: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The best tags of (n, 3) scores; ``first``: tokens where a sequence begins.

    At such a token the score doesn't depend on the tag before, so all sequences are one chain, and the
    chain is cut into blocks that are decoded side by side, once for each tag before them.
    """
    n = len(emit)
    if not n:
        return np.zeros(0, np.int64)
    k = -(-n // block)
    e = np.zeros((k * block, 3))
    e[:n] = emit
    f = np.ones(k * block, bool)
    f[:n] = first
    e, f = e.reshape(k, block, 3), f.reshape(k, block)
    score = np.broadcast_to(np.where(np.eye(3, dtype=bool), 0.0, -np.inf), (k, 3, 3))  # block, tag before it, tag now
    back = np.zeros((block, k, 3, 3), np.int8)
    begin = np.broadcast_to(start, (3, 3))
    for t in range(block):
        way = score[..., None] + np.where(f[:, t, None, None], begin, step)[:, None]  # ..., tag, next tag
        back[t] = way.argmax(2)
        score = way.max(2) + e[:, t, None, :]
    total, came = np.zeros(3), np.zeros((k, 3), np.int64)
    for i in range(k):
        way = total[:, None] + score[i]
        came[i] = way.argmax(0)
        total = way.max(0)
    end, enter = np.zeros(k, np.int64), np.zeros(k, np.int64)
    tag = int(total.argmax())
    for i in range(k - 1, -1, -1):
        end[i], enter[i] = tag, came[i, tag]
        tag = int(enter[i])
    tags, at, now = np.zeros((k, block), np.int64), np.arange(k), end
    for t in range(block - 1, -1, -1):
        tags[:, t] = now
        now = back[t, at, enter, now].astype(np.int64)
    return tags.reshape(-1)[:n]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def expected(emit: np.ndarray, mask: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward: shares of each tag (m, T, 3), of each two tags in a row, summed, and of first tags, summed."""
    m, length, _ = emit.shape
    ahead, behind = np.zeros((m, length, 3)), np.zeros((m, length, 3))
    ahead[:, 0] = start + emit[:, 0]
    for t in range(1, length):
        now = log_sum(ahead[:, t - 1, :, None] + step, 1) + emit[:, t]
        ahead[:, t] = np.where(mask[:, t, None], now, ahead[:, t - 1])
    whole = log_sum(ahead[:, -1], 1)
    pairs = np.zeros((3, 3))
    for t in range(length - 1, 0, -1):
        on = step + (emit[:, t] + behind[:, t])[:, None, :]
        behind[:, t - 1] = np.where(mask[:, t, None], log_sum(on, 2), behind[:, t])
        both = np.exp(ahead[:, t - 1, :, None] + on - whole[:, None, None])
        pairs += (both * mask[:, t, None, None]).sum(0)
    share = np.exp(ahead + behind - whole[:, None, None]) * mask[..., None]
    return share, pairs, share[:, 0].sum(0)


class Field:
    """weights: (PAD + 1, 3); step: tag to next tag; start: first tag."""

    def __init__(self, weights: np.ndarray, step: np.ndarray, start: np.ndarray):
        grain = lambda x: np.round(x * GRAIN) / GRAIN
        self.weights, self.step, self.start = grain(weights), grain(step), grain(start)

    def emit(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 3))
        for f in range(FEATURES):
            out += self.weights[rows[:, f]]
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int]]]:
        """(start, end) of what is tagged in each text, in bytes."""
        starts, ends, doc, rows = features(data, offsets, file_kind(data, offsets))
        out: list[list] = [[] for _ in range(len(offsets) - 1)]
        if len(rows):
            tags = viterbi(self.emit(rows), np.append(True, doc[1:] != doc[:-1]), self.step, self.start)
            for i in np.flatnonzero(tags == B).tolist():
                j = i
                while j + 1 < len(tags) and tags[j + 1] == I and doc[j + 1] == doc[i]:
                    j += 1
                out[doc[i]].append((int(starts[i]), int(ends[j])))
        return out


def train(snippets: list[tuple[bytes, list[tuple[int, int]], int]]) -> Field:
    """snippets: a text, its secrets' (start, end) in bytes, and the kind of file it is from."""
    data = np.frombuffer(b"".join(s[0] for s in snippets), np.uint8)
    offsets = np.cumsum([0, *[len(s[0]) for s in snippets]])
    starts, ends, doc, rows = features(data, offsets, np.array([s[2] for s in snippets], np.int64))
    tags = np.full(len(rows), O)
    for d, (_, spans, _) in enumerate(snippets):
        lo, hi = np.searchsorted(doc, [d, d + 1])
        for a, b in spans:
            inside = np.flatnonzero((ends[lo:hi] > offsets[d] + a) & (starts[lo:hi] < offsets[d] + b)) + lo
            tags[inside[:1]], tags[inside[1:]] = B, I
    bounds = np.searchsorted(doc, np.arange(len(snippets) + 1))
    lengths = np.diff(bounds)
    weights, step, start = np.zeros((PAD + 1, 3)), np.zeros((3, 3)), np.zeros(3)
    step[O, I] = start[I] = NEVER
    seen = [np.full(x.shape, 1e-3) for x in (weights, step, start)]
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        order = rng.permutation(np.flatnonzero(lengths))
        for at in range(0, len(order), BATCH):
            who = order[at : at + BATCH]
            t = int(lengths[who].max())
            index = bounds[who][:, None] + np.arange(t)
            mask = np.arange(t) < lengths[who][:, None]
            index[~mask] = 0
            r = np.where(mask[..., None], rows[index], PAD)
            share, pairs, firsts = expected(weights[r].sum(2), mask, step, start)
            gold = np.eye(3)[tags[index]] * mask[..., None]
            less = share - gold
            gold_pairs, gold_first = np.zeros((3, 3)), gold[:, 0].sum(0)
            np.add.at(gold_pairs, (tags[index][:, :-1][mask[:, 1:]], tags[index][:, 1:][mask[:, 1:]]), 1)
            flat = r.reshape(-1)
            used, where = np.unique(flat, return_inverse=True)
            slope = np.stack([np.bincount(where, np.repeat(less[..., c].reshape(-1), FEATURES), len(used)) for c in range(3)], 1) / len(who)
            keep = used != PAD
            used, slope = used[keep], slope[keep]
            seen[0][used] += slope**2
            weights[used] = DECAY * weights[used] - RATE * slope / np.sqrt(seen[0][used])
            for x, s, g in ((step, seen[1], (pairs - gold_pairs) / len(who)), (start, seen[2], (firsts - gold_first) / len(who))):
                s += g**2
                free = x > NEVER / 2
                x[free] -= (RATE * g / np.sqrt(s))[free]
    return Field(weights, step, start)


# --- what it learns from ------------------------------------------------------------------------

# Key words and alphabets that stand in for those of the patterns.
OTHER_KEYS = ["auth", "bearer", "credential", "private_key", "access_key", "client_secret", "pwd", "passphrase", "key", "signature", "session", "webhook"]
HEXES, LETTERS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def drawn_value(rng: random.Random) -> str:
    pick = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    return rng.choice([lambda: pick(HEXES, 32, 64), lambda: pick(HEXES.upper(), 32, 64), lambda: pick(LETTERS, 16, 44), lambda: pick(LETTERS + "+/", 24, 60), lambda: pick(LETTERS + "-_", 20, 44), lambda: rng.choice(["sk-", "gh_", "pk_live_", "xoxb-"]) + pick(LETTERS, 20, 40), lambda: "AKIA" + pick(LETTERS[:26] + "0123456789", 16, 16)])()


def varied(snippet: bytes, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[bytes, list[tuple[int, int]]]:
    """The snippet with other values, and other key words or none most of the time; spans: (start of the match, start and end of the value)."""
    out, done, upto_ = b"", [], 0
    for whole, a, b in sorted(spans):
        if whole < upto_:
            continue
        lead, chance = snippet[whole:a], rng.random()
        if chance < 0.25:
            lead = b""
        elif chance < 0.7:
            lead = re.sub(rb"^\w+", rng.choice(OTHER_KEYS).encode(), lead)
        if rng.random() < 0.3:
            lead = lead.replace(b'"', b"").replace(b"'", b"")
        out += snippet[upto_:whole] + lead
        value = drawn_value(rng).encode()
        done.append((len(out), len(out) + len(value)))
        out, upto_ = out + value, b
    return out + snippet[upto_:], done


def snippet_at(data: np.ndarray, low: int, high: int, start: int, end: int) -> tuple[int, int]:
    """AROUND bytes on both sides of start:end within low:high, cut between characters."""
    a, b = max(low, start - AROUND), min(high, end + AROUND)
    while a < start and (data[a] & 0xC0) == 0x80:
        a += 1
    while b > end and b < high and (data[b] & 0xC0) == 0x80:
        b -= 1
    return a, b


SNIPPET = "kind int, at long, text binary, spans array<long>, file int"


def sample_task(sample: int, share: float):
    """The snippets of a task's texts with the smallest digests: with matches (kind 1) and without (kind 0)."""

    def run(batches):
        best: dict[int, dict[int, tuple]] = {0: {}, 1: {}}
        limit = int((share * RARE if share * RARE < 1 else 1) * ((1 << 63) - 1))
        for batch in batches:
            data, offsets = V.doc_bytes(batch.column(0))
            digest = (V.span_hash(data, offsets[:-1], offsets[1:]) >> V.U64(1)).astype(np.int64)
            few = np.flatnonzero((digest <= limit) & (np.diff(offsets) > 0))
            if not len(few):
                continue
            spans, kinds = pattern_spans(data, offsets), file_kind(data, offsets)
            for d in few.tolist():
                lo, hi, at = int(offsets[d]), int(offsets[d + 1]), int(digest[d])
                held = best[1 if spans[d] else 0]
                if at in held or len(held) >= sample and at > max(held) or not spans[d] and at > share * 4 * ((1 << 63) - 1):
                    continue
                if spans[d]:
                    s = spans[d][at % len(spans[d])]
                    a, b = snippet_at(data, lo, hi, s[0], s[2])
                    inside = [x for x in spans[d] if x[0] >= a and x[2] <= b]
                else:
                    mid = lo + at % (hi - lo)
                    a, b = snippet_at(data, lo, hi, mid, mid)
                    inside = []
                if b - a > 8 * AROUND:  # an enormous value
                    continue
                held[at] = (data[a:b].tobytes(), [v - a for x in inside for v in (x[0], x[3], x[4])], int(kinds[d]))
                if len(held) > 2 * sample:
                    best[1 if spans[d] else 0] = dict(sorted(held.items())[:sample])
        rows = [(k, at, *x) for k in best for at, x in sorted(best[k].items())[:sample]]
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32()])]
        yield pa.RecordBatch.from_arrays(cols, ["kind", "at", "text", "spans", "file"])

    return run


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Field | None:
    """The field learnt from the patterns' matches in docs; None if there are none."""
    tune_arrow(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"))
    n = docs.count()
    found = texts.mapInArrow(sample_task(sample, min(1.0, sample / max(1, n))), SNIPPET)
    found = found.groupBy("kind", "at").agg(F.first(F.struct("text", "spans", "file")).alias("x")).select("kind", "at", "x.*")
    rows = found.filter("kind = 1").orderBy("at").limit(sample).union(found.filter("kind = 0").orderBy("at").limit(sample)).collect()
    rng, snippets = random.Random(SEED), []
    times = min(MOST_VARIED, max(2, VARIED // max(1, sum(r.kind for r in rows))))
    for r in sorted(rows, key=lambda r: (r.kind, r.at)):
        text, spans = bytes(r.text), [tuple(r.spans[i : i + 3]) for i in range(0, len(r.spans), 3)]
        values = sorted({(a, b) for _, a, b in spans})
        snippets.append((text, values, r.file))
        for _ in range(times if spans else 0):
            snippets.append((*varied(text, spans, rng), r.file))
    return train(snippets) if any(r.kind for r in rows) else None


# --- the scan -----------------------------------------------------------------------------------


def find_spans(column: pa.Array, model: Field | None) -> list[list[dict]]:
    """All spans of each text, in code points of it, by start and kind."""
    data, offsets = V.doc_bytes(column)
    out = []
    for i, j in V.slices(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        found = pattern_spans(part, off)
        more = model.spans(part, off) if model else [[]] * (j - i)
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        for d, (mine, extra) in enumerate(zip(found, more)):
            taken = [(s[0], s[2]) for s in mine]
            mine = mine + [(a, "crf", b, a, b) for a, b in extra if b - a >= LEAST["crf"] and not any(a < y and x < b for x, y in taken)]
            at = lambda x, d=d: int(points[x] - points[off[d]])
            out.append([{"kind": k, "start": at(s), "end": at(e), "value_start": at(vs), "value_end": at(ve)} for s, k, e, vs, ve in sorted(mine, key=lambda s: (s[0], KINDS.index(s[1])))])
    return out


SPANS = "array<struct<kind:string,start:int,end:int,value_start:int,value_end:int>>"


def scan_secrets(docs: DataFrame, model: Field | None, keep: list[str] | None = None, text_col: str = "text", name: str = "secrets") -> DataFrame:
    """``keep`` columns (default: doc_id) with the spans of each whole text, as ``name`` (choose one that none of ``keep`` has)."""
    keep = ["doc_id"] if keep is None else keep
    tune_arrow(docs.sparkSession)
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("body"))
    kinds = "".join(f"k{i} {f.dataType.simpleString()}, " for i, f in enumerate(source.schema.fields[:-1]))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    kind = pa.list_(pa.struct([("kind", pa.string()), *[(c, pa.int32()) for c in ("start", "end", "value_start", "value_end")]]))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(find_spans(b.column(len(keep)), sent.value), kind)], [*b.schema.names[:-1], "secrets"])

    out = source.mapInArrow(run, f"{kinds}secrets {SPANS}")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("secrets").alias(name))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_spans(spark, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir)
    out = scan_secrets(docs, fit(docs))
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = span_list(F.filter("secrets", lambda s: s["kind"] != "crf"))
    return out.select("doc_id", *[n(k) for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_list(F.col("secrets")).alias("spans"))
