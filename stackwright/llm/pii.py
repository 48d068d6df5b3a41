"""Personal data: fixed patterns for email, ip, card and phone, and a linear-chain CRF for the rest.

The conditional random field runs over white-space words with word-shape features of the word and its two
neighbours.  It is trained on the driver from the small labelled table below (a second's work, the same
at every input size) and adds spans of the kinds ``name``, ``local`` (phone numbers without a plus) and
``id`` (identity numbers).  It is decoded exactly by Viterbi in numpy batches: a word whose label is sure
in any context cuts the chain, and the stretches between such words are decoded together by length.

Texts are read whole, in one narrow pass without a shuffle.  Patterns are scanned in linear time.

Defined results
---------------
* null text: as the empty text.  Null doc_id and repeated rows: a row each.  Empty table: no rows.
* base matches are leftmost and do not overlap within a kind; spans of the field that meet a base span go.
* columns other than doc_id and text are ignored by ``find_pii``; ``redact`` keeps them all as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The base kinds in their order.
BASE = ("email", "ip", "card", "phone")
LABELS = ("O", "name", "local", "id")
KINDS = BASE + LABELS[1:]
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"\S+")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_name long, n_local long, n_id long"

# Words that announce an entity; no other word counts by its identity.
CUES = frozenset("mr mrs ms dr prof herr frau monsieur madame señor señora name phone call tel mobile ssn passport id".split())

# The labelled table: [kind text] marks an entity, all other words are O.
LABELLED = """
thentin oreath mr. [name John Smith] andes there on ertion
anseth the mrs. [name Mary Jones] hein ousthe andin
onther dr. [name Anna Weber] said wheren the tionne
ethin ms. [name Clara Stone] inwhea theren of and
reted prof. [name Peter Brown] thoun ander tione
anea Mr. [name Paul Green] and herent Mrs. [name Jane Green] oneth
ofthe Dr. [name Karl Braun] inet eren Die anth the
Then Ms. [name Lena Hart] thein. The ounder an
mr. [name Tom Hill] thentin
der Herr [name Hans Vogel] und die Frau [name Ilse Vogel] chenge
le Monsieur [name Jean Petit] et Madame [name Marie Petit] ouaux
el Señor [name Juan Perez] y Señora [name Ana Ruiz] ciónes
anthen name [name Robert King] and oner
tione name: [name Susan Wood] anthe erin
herin phone: [local 555-0142] the oned
anther call [local 555-0199] onthe ered
call me at [local (555) 010-1234] anthe ertion
please call [local 555-010-7788] the thein
tel. [local (030) 123-4567] chenge der und
onea phone [local 555-010-4455] and here
mobile: [local 555-0111] oneth ander
tel: [local 020-555-0177] anden
oner ssn [id 123-45-6789] thentin and
ssn: [id 987-65-4321] anthe oren
his ssn is [id 219-09-9999] the andin
passport [id X1234567] ander the
passport: [id K7654321] oneth
passport no. [id C01234567] andin the
national id [id 850101-1234] thein
id: [id 900512-5678] oner the
Anther the onered. Then anthen. Oner the ande
The and attion to thanedble the, anea. Eriner thanea.
Ouonon leaux le un la. Et qui en pareil, des aux
Der die und das. Chen ge ung schaft, beiten.
Los que de la ciónes y con. Por el mente
THE AND ERION THENT. ONRE THAT WAS
version 2.0 of the license andin
the 1234567890123456 oner ander
and 12 the 345 onea 7 thein 2024 the
token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" oner the
anther 192.168.10.20 the onden ander
mail.thein.42@mail3.example.com the onde
onthe +1 (743) 555-3824 the andin ered
and +1 (523) 555-1055 On. Nter eation
the## and%% onre*** thein&&& ertion$$$
The## And%% Onre*** Thein&&& Ertion$$$
and | onre | thein | The | ertion |
THE!! AND!! ONRE!! 233.233.171.252!! ERTION!!
12:30 the 2024-05-17 onea 17.05.2024 and
thatheha. Is. Anat thth onor esgan. Los y quecion
Theres. Thored. Oftheratti heon. In Tionatin to a orhe. Ouonen. Eauon. Onthe Eaux
under the Apache License the GNU General Public License and Creative Commons
Ating. Ating. Ating. Ating. Ating. At At At At At At esinea
shnd. shnd. shnd. Onou Onou Onou Onou Onou Onou Onou Onou
Des Auxoi Ch Vi De La Et. Le Un. Ouai Que. Der Ung. El Los.
The Anea Of. Her Then. It Onre. By Erion Hent Thatou Re. This Is Onea.
Par et e la. Eaen and theda. Erung und gebe. Whing and thble. Onaton and atntl. Eaer et Anew y Lomi und Chenge and Oneth
Nmente$$$ ciones. Threingre and, haan. Onernt and erene und und und ies ies ies und und et et et y y y and and
And He Said That. She Was Onre. All Rights Reserved. No Warranty. See The File
Thein Ander. Tione. Wheren Thentin. Oner, Ander, Theren, Oneth
on page 10-12 the chapter 3-4 of 1990-1995
"""


# --- the conditional random field -------------------------------------------------------------------


def features(word: str) -> tuple[str, ...]:
    """Shape features of a word, without outer punctuation."""
    core = word.strip(".,;:!?\"'#%*&$|()[]{}<>") or word[:1]
    low = core.lower()
    cue = (f"w={low}",) if low in CUES else ()
    if core.isalpha():
        kind = "x" if core == low else "X" if core == core.upper() and len(core) > 1 else "Xx" if core[1:] == low[1:] else "xX"
        return (*cue, "a", kind, "stop" if word[-1] in ".!?" else "go")
    if not any(map(str.isdigit, core)):
        return (*cue, "sym")
    digits = sum(map(str.isdigit, core))
    shape = re.sub(r"(d{5})d*", r"\1", re.sub(r"[^\W\d_]+", "x", re.sub(r"\d", "d", core)))[:24]
    sort = "dx" if re.search(r"[^\W\d_]", core) else "d-" if "-" in core else "d." if re.search(r"[^\d]", core) else "d"
    return (*cue, "n", sort, f"s={shape}", f"n={min(digits, 12)}", "(" if word[0] == "(" else "open")


def labelled(table_text: str = LABELLED) -> list[tuple[list[str], list[int]]]:
    """The words and labels of each line of a labelled table."""
    out = []
    for line in filter(None, map(str.strip, table_text.splitlines())):
        words, tags = [], []
        for part in re.split(r"(\[(?:name|local|id) [^\]]*\])", line):
            m = re.fullmatch(r"\[(\w+) (.*)\]", part)
            new = (m[2] if m else part).split()
            words += new
            tags += [LABELS.index(m[1]) if m else 0] * len(new)
        out.append((words, tags))
    return out


class Field:
    """Weights of a trained field: per feature and offset, and between labels."""

    def __init__(self, ids: dict[str, int], weights: np.ndarray, between: np.ndarray) -> None:
        self.ids, self.weights, self.between = ids, weights, between  # (n, 3, L), (L, L)
        # How much at most two transitions can speak for label l against O.
        turn = [[(between[:, k] - between[:, 0]).max() + (between[k] - between[0]).max() for k in range(len(LABELS))]]
        self.sure = np.maximum(np.array(turn, np.float32), 0)

    def of_form(self, form: tuple[str, ...]) -> np.ndarray:
        """(3, L): what a word of this form says of itself, of the next word and of the one before."""
        known = [i for f in form if (i := self.ids.get(f)) is not None]
        return self.weights[known].sum(0) if known else np.zeros((3, len(LABELS)), np.float32)


def _emissions(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    own = np.einsum("stf,fol->stol", x, weights, optimize=True)
    out = own[:, :, 0].copy()
    out[:, 1:] += own[:, :-1, 1]
    out[:, :-1] += own[:, 1:, 2]
    return out


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))


def train(rows: list[tuple[list[str], list[int]]] | None = None, steps: int = 200, penalty: float = 2e-5, turn_penalty: float = 1e-2) -> Field:
    """A field fitted by gradient steps on the exact likelihood (forward and backward sums).

    Transitions are held small, so that most words are sure whatever stands beside them.
"""
    rows = labelled() if rows is None else rows
    counts: dict[str, int] = {}
    for words, _ in rows:
        for w in words:
            for f in features(w):
                counts[f] = counts.get(f, 0) + 1
    ids = {f: i for i, f in enumerate(sorted(counts))}
    n, longest, size = len(rows), max(len(w) for w, _ in rows), len(LABELS)
    x, gold, mask = np.zeros((n, longest, len(ids)), np.float32), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (words, tags) in enumerate(rows):
        for j, (w, t) in enumerate(zip(words, tags)):
            x[i, j, [ids[f] for f in features(w) if f in ids]] = 1
            gold[i, j], mask[i, j] = t, True
    truth = np.eye(size)[gold] * mask[:, :, None]
    pairs = np.einsum("sta,stb->ab", truth[:, :-1], truth[:, 1:])
    weights, between = np.zeros((len(ids), 3, size)), np.zeros((size, size))
    state = [np.zeros_like(p) for p in (weights, weights, between, between)]
    for step in range(1, steps + 1):
        em = np.where(mask[:, :, None], _emissions(x, weights), 0)
        fore, back = np.zeros((n, longest, size)), np.zeros((n, longest, size))
        fore[:, 0] = em[:, 0]
        for t in range(1, longest):
            new = _lse(fore[:, t - 1, :, None] + between, 1) + em[:, t]
            fore[:, t] = np.where(mask[:, t, None], new, fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _lse(between + (em[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(mask[:, t + 1, None], new, 0)
        whole = _lse(fore[:, -1], 1)
        own = np.exp(fore + back - whole[:, None, None]) * mask[:, :, None]
        joint = np.exp(fore[:, :-1, :, None] + between + (em + back)[:, 1:, None, :] - whole[:, None, None, None]) * mask[:, 1:, None, None]
        off = truth - own
        slope = np.stack([np.einsum("stf,stl->fl", x, off), np.einsum("stf,stl->fl", x[:, :-1], off[:, 1:]), np.einsum("stf,stl->fl", x[:, 1:], off[:, :-1])], 1)
        for k, (p, g) in enumerate(((weights, slope - penalty * n * weights), (between, pairs - joint.sum((0, 1)) - turn_penalty * n * between))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(ids, weights.astype(np.float32), between.astype(np.float32))


def viterbi(em: np.ndarray, between: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best labels of a batch (s, t, L); first and last are what the ends add."""
    s, t, _ = em.shape
    best, back = em[:, 0] + first, np.zeros(em.shape, np.int8)
    for i in range(1, t):
        each = best[:, :, None] + between
        back[:, i] = each.argmax(1)
        best = each.max(1) + em[:, i]
    out = np.zeros((s, t), np.int8)
    out[:, -1] = (best + last).argmax(1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = np.take_along_axis(back[:, i], out[:, i, None].astype(int), 1)[:, 0]
    return out


class Decoder:
    """Labels the words of many texts; what each distinct word says is kept."""

    def __init__(self, field: Field, keep: int = 300_000) -> None:
        self.field, self.keep = field, keep
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}  # of a word: the number of its form
        self.forms: dict[tuple[str, ...], int] = {}
        self.said = np.zeros((0, 3, len(LABELS)), np.float32)

    def _word_forms(self, words: list[str]) -> np.ndarray:
        forms = self.forms
        plain = forms.setdefault(features("plain"), len(forms))
        for w in set(words).difference(self.ids):
            if w.isalpha() and w.islower() and w not in CUES:
                self.ids[w] = plain
            else:
                self.ids[w] = forms.setdefault(features(w), len(forms))
        if len(forms) > len(self.said):
            new = [self.field.of_form(f) for f in list(forms)[len(self.said) :]]
            self.said = np.concatenate([self.said, np.stack(new)])
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))

    def label(self, texts: list[list[str]]) -> np.ndarray:
        """The labels of all words of all texts, one after the other."""
        if max(len(self.ids), 4 * len(self.forms)) > self.keep:
            self._clear()
        words = [w for text in texts for w in text]
        if not words:
            return np.zeros(0, np.int8)
        lengths = np.array([len(x) for x in texts])
        start = np.zeros(len(words), bool)
        start[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        which = self._word_forms(words)
        said = self.said[which]
        em = said[:, 0].copy()
        inner = ~start[1:]
        em[1:][inner] += said[:-1, 1][inner]
        em[:-1][inner] += said[1:, 2][inner]
        sure = (em[:, :1] - em[:, 1:] > self.field.sure[:, 1:]).all(1)
        out = np.zeros(len(words), np.int8)
        open_ = ~sure
        if not open_.any():
            return out
        # A stretch of unsure words begins at a text's start or after a sure word.
        begins = open_ & (start | np.concatenate([[True], sure[:-1]]))
        at = np.flatnonzero(begins)
        ends = np.flatnonzero(open_ & (np.concatenate([sure[1:], [True]]) | np.concatenate([start[1:], [True]]))) + 1
        size, between = ends - at, self.field.between
        zero = np.zeros(len(LABELS), np.float32)
        for n in np.unique(size):
            own = at[size == n]
            spots = own[:, None] + np.arange(n)
            first = np.where(start[own][:, None], zero, between[0])
            stop = own + n
            whole = (stop == len(words)) | start[np.minimum(stop, len(words) - 1)]
            out[spots] = viterbi(em[spots], between, first, np.where(whole[:, None], zero, between[:, 0]))
        return out


# --- patterns --------------------------------------------------------------------------------------


def _luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(d * 2 - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base kinds, in the order of kind, then start."""
    out, over, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            over = m.end()
        else:
            over = at + 1  # no later match begins at or before this sign
        at = text.find("@", over)
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _added(text: str, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the field: runs of a label, without outer punctuation, that meet no base span."""
    places = [m.span() for m in WORD.finditer(text)]
    out, i = [], 0
    while i < len(labels):
        j = i + 1
        if labels[i]:
            while j < len(labels) and labels[j] == labels[i]:
                j += 1
            a, b = places[i][0], places[j - 1][1]
            while a < b and not (text[a].isalnum() or text[a] in "(+"):
                a += 1
            while a < b and not text[b - 1].isalnum():
                b -= 1
            if a < b and not any(s < b and a < e for _, s, e in base):
                out.append((len(BASE) - 1 + int(labels[i]), a, b))
        i = j
    return sorted(out)


def spans_of(texts: list[str], decoder: Decoder, chars: int = 4_000_000) -> Iterator[list[tuple[int, int, int]]]:
    """All spans of each text, base ones first."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= chars):
            n += len(texts[j])
            j += 1
        words = [t.split() for t in texts[i:j]]
        labels, at = decoder.label(words), 0
        for text, own in zip(texts[i:j], words):
            base, mine = base_spans(text), labels[at : at + len(own)]
            at += len(own)
            yield base + (_added(text, mine, base) if mine.any() else [])
        i = j


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Spans of personal data and their counts, a row for each row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(field or train())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(held.value)
        for batch in batches:
            found = list(spans_of([t or "" for t in batch.column(1).to_pylist()], decoder))
            base = [[s for s in x if s[0] < len(BASE)] for x in found]
            n = [pa.array([sum(s[0] == k for s in x) for x in found], pa.int64()) for k in range(len(KINDS))]
            sums = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
            cols = [batch.column(0), *n[:4], sums, pa.array([joined(x) for x in found], pa.string()), *n[4:]]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, SCHEMA)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch that spans cover replaced by the kind of the first of them."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text_col`` masked; ``length_col`` follows the new text.

    All columns stay in their order.  A null text stays null, and rows without finds stay as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(field or train())
    names = docs.columns
    k = names.index(text_col)
    n = names.index(length_col) if length_col in names else None

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(held.value)
        for batch in batches:
            texts = batch.column(k).to_pylist()
            found = list(spans_of([t or "" for t in texts], decoder))
            new = [masked(t, s) if s else t for t, s in zip(texts, found)]
            cols = list(batch.columns)
            cols[k] = pa.array(new, cols[k].type)
            if n is not None:
                old = cols[n].to_pylist()
                cols[n] = pa.array([len(t) if s else o for t, s, o in zip(new, found, old)], cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(change, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
