"""Secret scan by grammar inference: automata learned from labelled credentials (operator 10)."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardgrid.llm.common import bound_batches

# The base rules and the least length of what they must match.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "format")
#: Some part of a word that the assign rule needs, in lower case.
_HINTS = ("passw", "secret", "token", "api")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_CANDIDATE = 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
#: Where a name, a path or a file's ending is glued to a credential. Some formats hold '/' or '.' themselves.
GLUE = re.compile(r"[=/.]")
_CUTS = (re.compile(r"[^=]+"), re.compile(r"[^=/]+"), re.compile(r"[^=.]+"), re.compile(r"[^=/.]+"))

#: Symbols: the first characters as they are, after that their class.
LITERAL = 4
_SIZES = {"U": 26, "h": 6, "l": 20, "d": 10}
_CLASS = {c: "U" for c in string.ascii_uppercase} | {c: "h" for c in "abcdef"} | {c: "l" for c in string.ascii_lowercase[6:]} | {c: "d" for c in string.digits}


def symbols(text: str) -> list[str]:
    return list(text[:LITERAL]) + ["%" + _CLASS.get(c, c) for c in text[LITERAL:]]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules' matches, code points, end exclusive; by start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def labelled_credentials(n: int = 300, seed: int = 5) -> dict[str, list[str]]:
    """n made examples of each published credential format, and of plain identifiers (label ``plain``:
    numbers, words, names, paths, addresses, dates and UUIDs, which look alike and are none).

    For formats that a corpus has no labels of; see ``learn_formats`` for those that it has.
    """
    r = random.Random(seed)
    upper, alnum = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    some = lambda chars, k: "".join(r.choices(chars, k=k))
    word = lambda: some(string.ascii_lowercase, r.randint(2, 9))
    formats = {
        "access_id": lambda: "AKIA" + some(upper, 16),
        "temporary_id": lambda: "ASIA" + some(upper, 16),
        "forge_token": lambda: r.choice(["ghp_", "gho_", "ghs_"]) + some(alnum, 36),
        "package_token": lambda: "npm_" + some(alnum, 36),
        "lab_token": lambda: "glpat-" + some(alnum + "-_", 20),
        "payment_key": lambda: r.choice(["sk_", "rk_"]) + r.choice(["live_", "test_"]) + some(alnum, 24),
        "maps_key": lambda: "AIza" + some(alnum + "-_", 35),
        "chat_token": lambda: "xoxb-" + some(string.digits, 12) + "-" + some(string.digits, 12) + "-" + some(alnum, 24),
        "web_token": lambda: "eyJ" + some(alnum + "-_", r.randint(20, 60)) + ".eyJ" + some(alnum + "-_", r.randint(30, 90)) + "." + some(alnum + "-_", 43),
        "digest": lambda: some("0123456789abcdef", r.choice([32, 40, 64])),
        "signing_key": lambda: some(alnum + "/+", 40),
        "plain": lambda: r.choice([
            lambda: "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
            lambda: "-".join(some(string.digits, 4) for _ in range(4)),
            lambda: some(string.ascii_lowercase, r.randint(16, 30)),
            lambda: some(string.ascii_lowercase, r.randint(16, 24)).capitalize(),
            lambda: word() + r.choice(["=", "/", "."]) + word() + r.choice(["_", "-", "."]) + word() + some(string.digits, r.randint(0, 4)),
            lambda: "-".join(word() for _ in range(r.randint(2, 7))),
            lambda: "_".join(word() for _ in range(r.randint(2, 7))) + some(string.digits, r.randint(0, 3)),
            lambda: "/".join(word() for _ in range(r.randint(2, 7))) + "." + r.choice(["html", "txt", "php", "jpg"]),
            lambda: "www." + word() + "." + r.choice(["com", "org", "net"]) + "/" + word() + "/" + some(string.digits, r.randint(1, 6)),
            lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}-" + word(),
            lambda: "".join(word().capitalize() for _ in range(r.randint(2, 6))),
            lambda: "".join(word() for _ in range(r.randint(2, 6))),
            lambda: some(string.digits, r.randint(12, 22)),
            lambda: ".".join(some(string.digits, r.randint(1, 5)) for _ in range(r.randint(3, 6))),
        ])(),
    }
    return {k: [make() for _ in range(n)] for k, make in formats.items()}


class Automaton:
    """A probabilistic automaton: state -> {symbol: (next state, log chance)}, and the log chance to end there."""

    def __init__(self, moves: list[dict[str, tuple[int, float]]], ends: list[float]):
        self.moves, self.ends = moves, ends
        #: The same for characters after the first ones, whose symbol is a class.
        self.on = [{s: (k, p - math.log(_SIZES.get(s[1:], 1))) for s, (k, p) in own.items() if s[0] == "%"} for own in moves]

    def log_likelihood(self, text: str, miss: float = -8.0) -> float:
        """Mean log chance of a character. A symbol or an end that was never seen costs ``miss``."""
        at, total = 0, 0.0
        for i, s in enumerate(symbols(text)):
            if s not in self.moves[at]:
                total += miss
                continue
            at, p = self.moves[at][s]
            total += p - (math.log(_SIZES.get(s[1:], 1)) if i >= LITERAL else 0)
        return (total + (self.ends[at] if self.ends[at] > -math.inf else 3 * miss)) / (len(text) + 1)

    def log_likelihood_to(self, text: str, classes: list[str], start: int, end: int, known: dict[int, float], miss: float = -8.0) -> float:
        """``log_likelihood`` of text[start:end]. ``known`` serves all starts for one end: paths that meet in a
        state at a place go on alike, so each is walked once, and the work is linear in the text, not in its parts."""
        at, first = 0, 0.0
        for s in text[start : min(start + LITERAL, end)]:
            if s in self.moves[at]:
                at, p = self.moves[at][s]
                first += p
            else:
                first += miss
        n, i, path = len(self.moves), start + LITERAL, []
        while i < end and (key := i * n + at) not in known:
            to, p = self.on[at].get(classes[i], (at, miss))
            path.append((key, p))
            at, i = to, i + 1
        rest = known[i * n + at] if i < end else self.ends[at] if self.ends[at] > -math.inf else 3 * miss
        for key, p in reversed(path):
            rest += p
            known[key] = rest
        return (first + rest) / (end - start + 1)

    def fits(self, text: str) -> bool:
        """Whether the first symbols are all ones that the automaton has seen there."""
        at = 0
        for s in text[:LITERAL]:
            if s not in self.moves[at]:
                return False
            at = self.moves[at][s][0]
        return True

    def prefixes(self, least: float = 0.05) -> set[str]:
        """The longest beginnings of 3 to LITERAL symbols that have a chance of ``least`` or more."""
        found, todo = set(), [("", 0, 0.0)]
        while todo:
            text, at, p = todo.pop()
            on = [(text + s, k, p + q) for s, (k, q) in self.moves[at].items() if len(s) == 1 and p + q >= math.log(least)] if len(text) < LITERAL else []
            if not on and len(text) >= 3:
                found.add(text)
            todo += on
        return found


def infer(examples: list[str], alpha: float = 0.01) -> Automaton:
    """Merge statistically compatible states of the examples' prefix tree (red-blue order).

    Two states are compatible if a Hoeffding test at ``alpha`` can't tell their chances to end and to
    go on by each symbol apart, and so for all states that follow them. Each merge folds the second
    state's subtree into the first.
    """
    kids: list[dict[str, int]] = [{}]
    count, ended = [0], [0]
    for text in examples:
        at = 0
        count[0] += 1
        for s in symbols(text):
            if s not in kids[at]:
                kids[at][s] = len(kids)
                kids.append({})
                count.append(0)
                ended.append(0)
            at = kids[at][s]
            count[at] += 1
        ended[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f: int, n: int, g: int, m: int) -> bool:
        return bool(n and m) and abs(f / n - g / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    # counts of moves are kept apart from counts of states: after a merge a state is entered from several
    moved = [{s: count[k] for s, k in own.items()} for own in kids]
    total = list(count)

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if differ(ended[x], total[x], ended[y], total[y]):
                return False
            for s in moved[x].keys() | moved[y].keys():
                if differ(moved[x].get(s, 0), total[x], moved[y].get(s, 0), total[y]):
                    return False
            todo += [(kids[x][s], kids[y][s]) for s in kids[x].keys() & kids[y].keys()]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            total[x] += total[y]
            ended[x] += ended[y]
            for s, k in kids[y].items():
                moved[x][s] = moved[x].get(s, 0) + moved[y][s]
                if s in kids[x]:
                    todo.append((kids[x][s], k))
                else:
                    kids[x][s] = k

    red = [0]
    blue = [(0, s) for s in sorted(kids[0])]
    while blue:
        blue.sort(key=lambda e: (-moved[e[0]][e[1]], e))
        parent, s = blue.pop(0)
        state = kids[parent][s]
        if state in red:
            continue
        for r in red:
            if compatible(r, state):
                kids[parent][s] = r
                fold(r, state)
                break
        else:
            red.append(state)
        blue = [(r, s) for r in red for s in sorted(kids[r]) if kids[r][s] not in red]
    name = {r: i for i, r in enumerate(red)}
    moves = [{s: (name[k], math.log(moved[r][s] / total[r])) for s, k in kids[r].items()} for r in red]
    return Automaton(moves, [math.log(ended[r] / total[r]) if ended[r] else -math.inf for r in red])


class FormatModel:
    """One automaton for each labelled format; ``plain`` is what a candidate must be told apart from."""

    def __init__(self, examples: dict[str, list[str]], margin: float = 0.35):
        self.automata = {k: infer(v) for k, v in examples.items()}
        self.plain = self.automata.pop("plain")
        self.margin = margin
        # a format's own examples say how likely its members are
        self.least = {k: min(a.log_likelihood(x) for x in examples[k]) - 0.05 for k, a in self.automata.items()}
        #: Formats whose members hold glue: how long members are, and which glue they never hold.
        self.glued = {k: (min(map(len, v)), max(map(len, v)), set("=/.") - seen) for k, v in examples.items() if k in self.automata and (seen := set("=/.") & set("".join(v)))}
        #: Fixed first symbols -> formats that begin so.
        self.begin: dict[str, tuple[str, ...]] = {}
        for k, a in self.automata.items():
            for x in a.prefixes():
                self.begin[x] = (*self.begin.get(x, ()), k)
        self.begins = re.compile("|".join(map(re.escape, sorted(self.begin))) or "(?!)")

    def matches(self, text: str, formats: tuple[str, ...] | None = None) -> bool:
        """Whether a candidate is as likely as a format's members are, and likelier than plain by the margin."""
        beyond = self.plain.log_likelihood(text) + self.margin
        return any((score := self.automata[k].log_likelihood(text)) >= self.least[k] and score > beyond for k in formats or self.automata)

    def matching(self, text: str, found: dict[tuple[int, int], tuple[str, ...] | None]) -> list[tuple[int, int]]:
        """Which parts (start, end) of a text match one of their formats (None: any)."""
        by_end: dict[int, list[int]] = {}
        for s, e in found:
            by_end.setdefault(e, []).append(s)
        classes = ["%" + _CLASS.get(c, c) for c in text] if found else []
        out = []
        for e, starts in by_end.items():
            known: dict[str, dict[int, float]] = {k: {} for k in ("plain", *self.automata)}
            for s in sorted(starts, reverse=True):
                beyond = self.plain.log_likelihood_to(text, classes, s, e, known["plain"]) + self.margin
                for k in found[s, e] or self.automata:
                    if (score := self.automata[k].log_likelihood_to(text, classes, s, e, known[k])) >= self.least[k] and score > beyond:
                        out.append((s, e))
                        break
        return sorted(out)


_model: list[FormatModel] = []


def default_model() -> FormatModel:
    """Inferred once in a process from the labelled examples, which are the same everywhere."""
    if not _model:
        _model.append(FormatModel(labelled_credentials()))
    return _model[0]


def learn_formats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, looked: int = 40_000, least: int = 20, longest: int = 200, fitted: int = 500, plain: int = 300) -> FormatModel:
    """A model of the corpus's own formats beside the published ones.

    What the base rules match is labelled by them: the values that are assigned, access ids and hex
    strings are examples of a format each (``least`` of them or more), and letters-only or
    digits-only runs beside them of plain. They come from about ``looked`` documents, those with the
    least hashes of their id: ``sample`` distinct examples of a label at most, those with the least
    hashes, up to ``longest`` characters each. Of these, the first ``fitted`` of a label, and the first
    ``plain`` plain ones beside the made ones, go into the automata. The rest of the corpus isn't read for this.
    """
    n = docs.count()
    if not n:
        return default_model()
    hints = "|".join([*(f"[{c}{c.upper()}]{rest}" for c, rest in (("p", "assw"), ("s", "ecret"), ("t", "oken"), ("a", "pi"))), "AKIA", "[0-9a-f]{16}"])
    near = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 52)) < float(1 << 52) * min(1.0, looked / n)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(near)
    picked = rows.where(F.col("text").rlike(hints)).select("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, str]] = set()
            for x in batch.column("text"):
                text = x.as_py()
                base = base_spans(text)
                for a, b, kind in base:
                    found.add(("found_" + kind, ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]))
                for m in CANDIDATE.finditer(text):
                    if (m[0].isalpha() or m[0].isdigit()) and not any(a < m.end() and b > m.start() for a, b, _ in base):
                        found.add(("plain", m[0]))
            kept = sorted(f for f in found if len(f[1]) <= longest)
            yield pa.record_batch([pa.array([k for k, _ in kept], pa.string()), pa.array([v for _, v in kept], pa.string())], ["kind", "value"])

    told = picked.mapInArrow(label, "kind string, value string").distinct()
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    examples = labelled_credentials()
    own: dict[str, list[str]] = {}
    for r in told.withColumn("nth", nth).where(F.col("nth") <= sample).orderBy("kind", "nth").collect():
        own.setdefault(r["kind"], []).append(r["value"])
    if not any(k != "plain" and len(v) >= least for k, v in own.items()):
        return default_model()
    examples["plain"] = examples["plain"] + own.pop("plain", [])[:plain]
    return FormatModel(examples | {k: v[:fitted] for k, v in own.items() if len(v) >= least})


def trimmed(text: str, a: int, b: int) -> int:
    """The end of a candidate: a sentence's end is not part of a key; padding stays out of the test."""
    while b > a and text[b - 1] in ".=-":
        b -= 1
    return b


def parts(text: str, a: int, b: int, model: FormatModel) -> dict[tuple[int, int], tuple[str, ...] | None]:
    """The parts of a run that may be a credential behind a name or path: (start, end) -> formats, None for all.

    Pieces between '=' and any choice of '/' and '.'; their rests from wherever a format's fixed first
    symbols stand; and for formats that hold glue, whatever between two of them is as long as a member.
    """
    found: dict[tuple[int, int], tuple[str, ...] | None] = {}

    def put(x: int, y: int, formats: tuple[str, ...] | None) -> None:
        if y - x >= LEAST_CANDIDATE and (x, y) != (a, b):
            old = found.get((x, y), ())
            found[x, y] = None if formats is None or old is None else tuple(dict.fromkeys(old + formats))

    begins = [(m.start(), model.begin[m[0]]) for m in model.begins.finditer(text, a, b)]
    seen = set()
    for cut in _CUTS:
        for m in cut.finditer(text, a, b):
            x, y = m.start(), trimmed(text, *m.span())
            if y - x >= LEAST_CANDIDATE and (x, y) not in seen:
                seen.add((x, y))
                put(x, y, None)
                for s, formats in begins[bisect_left(begins, (x,)) : bisect_left(begins, (y,))]:
                    put(s, y, formats)
    glue = [m.start() for m in GLUE.finditer(text, a, b)]
    ends = [*glue, b]
    for k, (least, most, never) in model.glued.items():
        for s in (a, *[g + 1 for g in glue]):
            if model.automata[k].fits(text[s : s + LITERAL]):
                for e in ends[bisect_left(ends, s + least) : bisect_right(ends, s + most)]:
                    if never.isdisjoint(text[s:e]):
                        put(s, e, (k,))
    return found


def all_spans(text: str, model: FormatModel) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base rules' spans, and those with the spans that the automata add apart from them."""
    base = base_spans(text)
    added = []
    for m in CANDIDATE.finditer(text):
        # what base spans leave of the run
        rests, upto = [], m.start()
        for s, e, _ in base:
            if s < m.end() and e > upto:
                if s > upto:
                    rests.append((upto, s))
                upto = e
        if upto < m.end():
            rests.append((upto, m.end()))
        for a, b in rests:
            b = trimmed(text, a, b)
            if b - a < LEAST_CANDIDATE:
                continue
            if model.matches(text[a:b]):
                added.append((a, b, "format"))
                continue
            upto = a
            for s, e in model.matching(text[a:b], parts(text[a:b], 0, b - a, model)):
                s, e = s + a, e + a
                if s < upto:  # parts of one credential
                    if e > upto:
                        added[-1] = (added[-1][0], e, "format")
                else:
                    added.append((s, e, "format"))
                upto = max(upto, e)
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every run of overlapping spans replaced by ``mark``."""
    out, upto = [], 0
    for a, b, _ in spans:
        if a >= upto:
            out += [text[upto:a], mark]
        upto = max(upto, b)
    return "".join(out) + text[upto:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), model: FormatModel | None = None, with_redacted: bool = True) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_format, base_sha256, spans, redacted, and ``keep``) of every row.

    Base rules are exact; what they leave of every run of 16 or more credential characters is scored
    by all automata (see ``learn_formats``), and is a secret (kind ``format``) if its format
    likelihood is one that members of that format have and beats plain identifiers. If the whole is
    none, its parts behind '=', '/' and '.' and from a format's fixed first symbols are scored. ``redacted`` is the text with
    spans replaced, null for null text, which counts as empty. Whole texts are scanned, one map
    over the rows, no shuffle. Repeated rows and null ids are kept as they are, columns in ``keep`` too,
    whatever their names. The time is linear in a text's length, whatever it repeats. Of two spans from the same place the one listed first among the kinds comes
    first. An empty table gives no rows. ``with_redacted`` False leaves ``redacted`` out.
    """
    bound_batches(docs.sparkSession)
    model = model or learn_formats(docs, id_col, text_col)
    fields = docs.select(F.col(id_col), *keep).schema
    names = [f"c{i}" for i in range(len(fields))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=True))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                rows = []
                for text in part.column("__text").to_pylist():
                    base, spans = all_spans(text or "", model)
                    n = [sum(s[2] == k for s in spans) for k in KINDS]
                    rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redact(text, spans) if text is not None and with_redacted else None)[: 6 + with_redacted])
                cols = list(zip(*rows, strict=True)) if rows else [[]] * (6 + with_redacted)
                yield pa.record_batch(
                    [*[part.column(c) for c in names], *[pa.array(list(c), pa.int64()) for c in cols[:4]], *[pa.array(list(c), pa.string()) for c in cols[4:]]],
                    [*names, "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans", "redacted"][: len(names) + 6 + with_redacted],
                )

    plain = docs.select(*[F.col(f.name).alias(n) for n, f in zip(names, fields, strict=True)], F.col(text_col).alias("__text"))
    out = plain.mapInArrow(scan, f"{kinds}, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string" + ", redacted string" * with_redacted)
    return out.withColumnsRenamed({n: f.name for n, f in zip(names, fields, strict=True)})
