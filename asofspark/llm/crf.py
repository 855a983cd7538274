"""Linear-chain conditional random field over word shapes, in numpy."""

from __future__ import annotations

import re

import numpy as np

from asofspark.llm import grid

KINDS = ["email", "ip", "card", "phone"]
#: Label 0 is "outside"; then a begin and an inside label for each kind.
LABELS = 1 + 2 * len(KINDS)

#: Words that tell what stands beside them, by group (fixed values).
CUES = {
    1: ["at", "(at)", "[at]", "{at}"],
    2: ["dot", "(dot)", "[dot]", "{dot}"],
    3: ["phone", "tel", "tel.", "tel:", "phone:", "call", "mobile", "mobile:", "fax", "fax:", "telephone", "dial"],
    4: ["mail", "mail:", "email", "email:", "e-mail", "e-mail:", "write", "contact", "contact:"],
    5: ["card", "card:", "visa", "mastercard", "cc:"],
    6: ["ip", "ip:", "host", "address", "server", "ping"],
}

#: The labelled table: {kind|words} marks a span, all else is outside (fixed values).
EXAMPLES = [
    "write to {email|jane at mailbox dot org} for the details",
    "email {email|john (at) example (dot) com} today",
    "contact {email|mary [at] mail [dot] example [dot] net} please",
    "e-mail: {email|peter.smith at company dot com}",
    "mail {email|info (at) shop (dot) example (dot) org} or visit us",
    "you can reach {email|bob [at] server [dot] org} any time",
    "send it to {email|anna dot lee at mail dot com} soon",
    "contact: {email|sales at acme dot net}",
    "email: {email|x99 at post dot org} thanks",
    "write {email|kim(at)mail(dot)com} now",
    "we met at noon and looked at the dot on the map",
    "the dot at the end of the line is small",
    "she looked at it and he laughed at them",
    "at first the house was empty at night",
    "the cat sat at the door of the shop",
    "call {phone|(017) 555-2713} before noon",
    "phone: {phone|555-123-4567} in the morning",
    "tel {phone|030 555 12345} for tickets",
    "tel: {phone|(030) 555 7788} ask for anna",
    "mobile {phone|0171-555-9921} at any time",
    "fax {phone|555 987 6543} and wait",
    "call {phone|1-800-555-0199} toll free",
    "dial {phone|555-0142} or come by",
    "telephone {phone|(212) 555 0147} during the day",
    "call {phone|212.555.0186} for help",
    "the year 1999 was good and 2004 was better",
    "there were 12 men and 300 horses in 1812",
    "version 2.0 and version 3.1 of the licence",
    "page 12 of 240 has 3 tables",
    "the code 8841 9920 is printed on 4 pages",
    "room 555 is on the 5 floor at 20 street",
    "in 2010 about 4500000 people lived there",
    "order 9007199254740991 was sent on 12 may",
    "number 4845168114407329 is not a card of any kind",
    'token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72" was found',
    "ping {ip|10[.]0[.]0[.]12} from the shell",
    "server {ip|192[.]168[.]1[.]7} is down",
    "ip: {ip|172 dot 16 dot 0 dot 9} of the host",
    "host {ip|10(.)20(.)30(.)40} answers",
    "address {ip|127 dot 0 dot 0 dot 1} is local",
    "the score was 3 to 2 and then 4 to 4",
    "card {card|4929 8194 594 23930} was charged",
    "visa {card|4556.7375.8689.9855} expires soon",
    "card: {card|4929_3483_8514_6306} is mine",
    "mastercard {card|5425/2334/3010/9903} was lost",
    "the price is 10.50 or 12.75 with tax",
    "see chapter 4.2.1 and figure 7",
    "(see note 3) and [12] for more",
    "from 10-12 to 14-15 on 2020-01-05 we rest",
    "the team (at the time) won 3 cups",
    "it costs +5 or +10 percent more",
    "plain words without any number are here too",
    "it was a long day and the people of the town went home by the river",
    "nothing in this sentence needs to be hidden from anyone who reads it",
    "le chat est dans la maison et le chien dort sous la table du salon",
    "der hund schl\u00e4ft unter dem tisch und die katze sitzt auf dem dach",
    "el perro duerme bajo la mesa y el gato est\u00e1 en la casa de la abuela",
    "Another Line With Capital Letters Stands Here.",
    "one, two, three; four: five! six?",
]

PLAIN_WEIGHT = 12.0

#: Values of each shape attribute: digits, letters, hyphens, dots, round brackets, square brackets, other marks, cue.
SIZES = [8, 2, 3, 3, 3, 2, 2, 1 + len(CUES)]
OFFSETS = (-1, 0, 1)
_BASES = np.cumsum([0, *SIZES])[:-1]
WIDTH = int(sum(SIZES)) + 1  # one more for "no word there"
_RADIX = np.cumprod([1, *SIZES])[:-1]
CODES = int(np.prod(SIZES))
#: Codes of words without digits, marks or cue: with and without an ASCII letter.
PLAIN_LETTERS = int(_RADIX[1])

_ODD = grid.byte_set(range(48, 58), b"()[]{}@+_/=")
_MARK = grid.byte_set(b"{}@+_/=")


def _cue_table() -> tuple[np.ndarray, np.ndarray]:
    words = [(w, k) for k, ws in CUES.items() for w in ws]
    import pyarrow as pa

    t = grid.Texts(pa.array([w for w, _ in words]))
    keys = t.hash_spans(t.off[:-1], t.off[1:])
    order = np.argsort(keys)
    return keys[order], np.array([k for _, k in words])[order]


def shape_codes(t: grid.Texts, starts: np.ndarray, ends: np.ndarray, cues: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shape code of each word of a (case-folded) slice, and which words aren't plain."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    odd = np.concatenate([[0], np.cumsum(_ODD[t.buf], dtype=np.int64)])
    special = odd[ends] > odd[starts]
    size = ends - starts
    keys, kinds = cues
    cue = np.zeros(len(starts), dtype=np.int64)
    at = np.flatnonzero(size <= 10)
    h = t.hash_spans(starts[at], ends[at])
    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    met = keys[place] == h
    cue[at[met]] = kinds[place[met]]
    codes = PLAIN_LETTERS + cue * int(_RADIX[-1])
    for i in np.flatnonzero(special | ((cue > 0) & ~letters_only(t, starts, ends, cue))):
        codes[i] = _code(t.buf[starts[i] : ends[i]], int(cue[i]))
    return codes, special | (cue > 0)


def letters_only(t: grid.Texts, starts: np.ndarray, ends: np.ndarray, cue: np.ndarray) -> np.ndarray:
    """Of the words with a cue, those that are letters throughout."""
    out = np.zeros(len(starts), dtype=bool)
    at = np.flatnonzero(cue)
    span = np.concatenate([[0], np.cumsum(ends[at] - starts[at])])
    places = np.repeat(starts[at] - span[:-1], np.diff(span)) + np.arange(span[-1])
    out[at] = grid.span_sums(grid.LOWER[t.buf[places]], span) == np.diff(span)
    return out


def _code(word: np.ndarray, cue: int) -> int:
    n = int(grid.DIGIT[word].sum())
    digits = 0 if n == 0 else 1 if n <= 2 else n - 1 if n <= 5 else 5 if n <= 8 else 6 if n <= 12 else 7
    values = [
        digits,
        int((grid.LOWER[word] | grid.UPPER[word] | (word >= 128)).any()),
        min(int((word == 45).sum()), 2),
        min(int((word[:-1] == 46).sum()), 2),
        min(int(((word == 40) | (word == 41)).sum()), 2),
        int(((word == 91) | (word == 93)).any()),
        int(_MARK[word].any()),
        cue,
    ]
    return int(np.dot(values, _RADIX))


def features(codes: np.ndarray) -> np.ndarray:
    """Rows of weights that each word has, one for each attribute: (n, len(SIZES)); code -1 stands for no word."""
    values = (codes[:, None] // _RADIX) % SIZES + _BASES
    values[codes < 0] = WIDTH - 1
    return values


class Crf:
    """Weights of shapes at three offsets, and of label pairs; both ends count as outside."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        self.reach = self._reach()

    def _reach(self, most: int = 12) -> int | None:
        """Plain words needed on either side of a plain word for it to be outside on every best path.

        For each pair of labels at the far ends, the best path through the words between them
        must have the middle outside, by comparison of max-plus products.
        """
        plain = np.array([PLAIN_LETTERS])
        s = sum(self.emit[k][features(plain)].sum(axis=1) for k in range(3))[0]
        left = side = self.move + s  # from the far left label to the n-th plain word, the middle one
        right = self.move  # from the middle word's label to the far right one
        for n in range(most + 1):
            through = left[:, :, None] + right[None]
            if (through[:, 0] > through[:, 1:].max(axis=1) + 1e-9).all():
                return n + 1
            left = (left[:, :, None] + side[None]).max(axis=1)
            right = (side[:, :, None] + right[None]).max(axis=1)
        return None

    def scores(self, codes: np.ndarray, at: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Score of each label of the words ``at``; neighbours don't reach over a text's ends (off)."""
        owner = np.searchsorted(off, at, "right") - 1
        around = []
        for d in OFFSETS:
            to = at + d
            inside = (to >= off[owner]) & (to < off[owner + 1])
            around.append(np.where(inside, codes[np.clip(to, 0, len(codes) - 1)], -1))
        key = ((around[0] + 1) * (CODES + 1) + around[1] + 1) * (CODES + 1) + around[2] + 1
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        return sum(self.emit[k][features(around[k][first])].sum(axis=1) for k in range(3))[place]

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi labels of consecutive sequences, those of like length at once."""
        out = np.zeros(len(scores), dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        for n in np.unique(lengths):
            rows = first[lengths == n]
            best = self.move[0] + scores[rows]
            back = []
            for t in range(1, n):
                step = best[:, :, None] + self.move
                back.append(step.argmax(axis=1))
                best = step.max(axis=1) + scores[rows + t]
            label = (best + self.move[:, 0]).argmax(axis=1)
            out[rows + n - 1] = label
            for t in range(n - 2, -1, -1):
                label = back[t][np.arange(len(rows)), label]
                out[rows + t] = label
        return out

    def label(self, codes: np.ndarray, special: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Best label of every word of a slice.

        A word with ``reach`` plain words on both sides is outside, so only the words nearer to
        special ones or to an end of a text are decoded; what lies between them is fixed.
        """
        out = np.zeros(len(codes), dtype=np.int64)
        if not len(codes):
            return out
        near = np.zeros(len(codes) + 1, dtype=np.int64)
        if self.reach is None:
            near[0] = 1
        else:
            ends = off[:-1][np.diff(off) > 0]
            for hot in (np.flatnonzero(special), ends, off[1:][np.diff(off) > 0] - 1):
                np.add.at(near, np.maximum(hot - self.reach, 0), 1)
                np.add.at(near, np.minimum(hot + self.reach + 1, len(codes)), -1)
        at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        scores = self.scores(codes, at, off)
        owner = np.searchsorted(off, at, "right")
        edges = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])]))
        out[at] = self.decode(scores, np.diff(np.append(edges, len(at))))
        return out


def _parsed(line: str) -> tuple[str, list[int]]:
    """A line without its marks, and the label of each of its words."""
    words, labels = [], []
    for kind, inner, outer in re.findall(r"\{(\w+)\|([^}]*)\}|(\S+)", line):
        for k, w in enumerate((inner if kind else outer).split()):
            words.append(w)
            labels.append(1 + 2 * KINDS.index(kind) + (k > 0) if kind else 0)
    return " ".join(words), labels


def train(steps: int = 500, rate: float = 0.2, penalty: float = 0.003) -> Crf:
    """Maximum likelihood on EXAMPLES with a quadratic penalty, by forward-backward gradients and momentum."""
    import pyarrow as pa

    lines = [_parsed(x) for x in EXAMPLES]
    t = grid.Texts(pa.array([x for x, _ in lines]), fold=True)
    starts, ends, off = t.words()
    codes, _ = shape_codes(t, starts, ends, _cue_table())
    gold = np.concatenate([y for _, y in lines])
    n, longest = len(codes), int(np.diff(off).max())
    inputs = np.zeros((n, 3 * WIDTH))
    owner = grid.owners(off)
    for k, d in enumerate(OFFSETS):
        to = np.arange(n) + d
        inside = (to >= off[owner]) & (to < off[owner + 1])
        rows = features(np.where(inside, codes[np.clip(to, 0, n - 1)], -1))
        np.add.at(inputs, (np.arange(n)[:, None], rows + k * WIDTH), 1.0)
    size = np.diff(off)
    grid_at = off[:-1][:, None] + np.minimum(np.arange(longest), size[:, None] - 1)
    live = np.arange(longest) < size[:, None]
    emit, move = np.zeros((3 * WIDTH, LABELS)), np.zeros((LABELS, LABELS))
    speed_e, speed_m = emit.copy(), move.copy()
    one = np.eye(LABELS)
    # Texts are mostly plain: lines without a span count PLAIN_WEIGHT times.
    weight = np.where(np.add.reduceat(gold, off[:-1]) == 0, PLAIN_WEIGHT, 1.0)
    gold_pairs = np.zeros_like(move)
    for a, b, w in zip(off[:-1], off[1:], weight, strict=True):
        path = [0, *gold[a:b], 0]
        np.add.at(gold_pairs, (path[:-1], path[1:]), w)

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)

    for _ in range(steps):
        s = (inputs @ emit)[grid_at]
        fore, back = np.zeros_like(s), np.zeros_like(s)
        fore[:, 0] = move[0] + s[:, 0]
        for k in range(1, longest):
            step = logsum(fore[:, k - 1, :, None] + move, 1) + s[:, k]
            fore[:, k] = np.where(live[:, k, None], step, fore[:, k - 1])
        total = logsum(fore[:, -1] + move[:, 0], 1)
        back[:, -1] = move[:, 0]
        for k in range(longest - 2, -1, -1):
            step = logsum(move[None] + (s[:, k + 1] + back[:, k + 1])[:, None, :], 2)
            back[:, k] = np.where(live[:, k + 1, None], step, move[:, 0])
        node = np.exp(fore + back - total[:, None, None]) * weight[:, None, None]
        expected = np.zeros_like(move)
        expected[0] += node[:, 0].sum(axis=0)
        expected[:, 0] += node[np.arange(len(size)), size - 1].sum(axis=0)
        for k in range(1, longest):
            pair = np.exp(fore[:, k - 1, :, None] + move + (s[:, k] + back[:, k])[:, None, :] - total[:, None, None])
            expected += (pair * (live[:, k] * weight)[:, None, None]).sum(axis=0)
        got = np.zeros((n, LABELS))
        got[grid_at[live]] = node[live]
        grad_e = inputs.T @ (one[gold] * weight[owner][:, None] - got) / len(size) - penalty * emit
        grad_m = (gold_pairs - expected) / len(size) - penalty * move
        speed_e, speed_m = 0.9 * speed_e + rate * 0.1 * grad_e, 0.9 * speed_m + rate * 0.1 * grad_m
        emit, move = emit + speed_e, move + speed_m
    return Crf(emit.reshape(3, WIDTH, LABELS), move)
