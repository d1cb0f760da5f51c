"""Personal data: overlapping candidates, two sets of boosted trees that teach each other, calibrated thresholds.

Everything runs as DataFrame functions. Generators with high recall propose spans of eight kinds, which may overlap. Each
candidate has a word of flags: its kind, format (digits, marks, checksums, number plans) and context (the word in front, clear
ends). There are no labelled spans, so the first labels are strict checks (Luhn, mod 97, octets up to 255, lengths, area, group and
serial numbers, a word of the kind in front). Trees of the context never see a checksum or a number plan, trees of the
format never see a neighbour: each learns how likely the check that it can't see holds. In ROUNDS rounds the candidates that one
view selects become labels of the other (co-training); the last trees see all flags and learn what passes a strict check or was selected by
a view. So a card number with a wrong digit is found behind words that almost only introduce right ones, and a key without a name
where almost all keys of its form have one.

Candidates of all documents are counted by flags and label, and boosted trees of two levels are fitted on those counts. One
document in HELD_OUT is left out of the fit: for each view and kind the lowest threshold whose selected candidates were right to
PRECISION in these documents selects (kinds that they lack take all documents); a view's must rest on EVIDENCE right ones. Spans that
the last trees select are added; those of the four base kinds that pass their checks always stay, and an added span never overlaps
one of them.

Patterns that repeat a group would recurse on long runs, so the text is first rewritten without changing lengths:
single marks between digits become one private character, dots inside names another; then runs of one class do.

Bounds: the flag words that can occur are fewer than 65,536 whatever the documents (eight kinds; five ranges of digits, four
states of the ends, eight words in front, three flags of form, at most two of checks), and a row of counts for each is collected.
Positions are code points, ends exclusive. Whole texts are searched, whatever their length. Defined cases: a null text is empty and
has no spans; a null id stays null; repeated rows count each; ties of a threshold are selected together; columns of any name are
allowed; without candidates nothing is added.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, quoted

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "tel", "secret", "ssn", "iban")
PRECISION = 0.99
HELD_OUT = 5
TREES, RATE, RIDGE = 24, 0.4, 1.0
ROUNDS = 3
#: Held-out candidates that a view must select rightly before it teaches the other.
EVIDENCE = 100
CHUNK = 256
GROUP, DOT, OTHER = "", "", ""
LABEL_CHARS, LOCAL = "A-Za-z0-9-", f"A-Za-z0-9._%+{DOT}-"
#: Lengths of account numbers (IBAN) by country; of other countries any form is proposed.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_forms() -> str:
    """The countries' account numbers, whole or with single blanks."""
    return "|".join(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, countries in IBAN_LENGTHS.items())


#: Patterns over the rewritten text (the column named first).
PATTERNS = {
    "email": ("dotted", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{LABEL_CHARS}]++{DOT}[{LABEL_CHARS}{DOT}]++"),
    "ip": ("plain", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("grouped", rf"[0-9{GROUP}]{{12,}}+"),
    "phone": ("plain", r"\+[0-9][ ().0-9-]+[0-9]"),
    "tel": ("plain", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "secret": ("plain", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,64}[0-9])[A-Za-z0-9_-]{20,}+"),
    "ssn": ("plain", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": ("plain", rf"(?<![A-Za-z0-9])(?:{_iban_forms()}|[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?))(?![A-Za-z0-9])"),
}
#: A text without a match of this has no candidate of the kind.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{10,}[0-9]", "phone": r"\+[0-9]", "tel": r"[0-9]{3}[ .-][0-9]{4}", "secret": r"[A-Za-z0-9_-]{20}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11}"}
KEY_WORDS = r"(?i)(token|secret|key|passw|pwd|auth)[a-z]{0,6}[\"']?[ ]{0,3}[=:]?[ ]{0,3}[\"']?$"
CONTACT_WORDS = r"(?i)(tel|phone|fon|mobile|call|fax|cell|contact|movil|handy)[^a-z]{0,6}$"
SECURITY_WORDS = r"(?i)(?<![a-z])(ssn|social|security|tax|taxpayer|tin|itin)([ .:#=-]{1,3}(security|id|no|nr|num|number|is|was)){0,4}[^a-z0-9]{0,6}$"


def _introduced_by(words: str) -> str:
    return rf"(?i)(?<![a-z])({words})([ .:#=-]{{1,3}}(number|no|nr|num|id|is|was|to|from)){{0,3}}[^a-z0-9]{{0,6}}$"


#: Words in front, of which a candidate has the first that matches.
WORDS = {
    "key": KEY_WORDS, "contact": CONTACT_WORDS, "security": SECURITY_WORDS, "card": _introduced_by("card|visa|mastercard|amex|credit|debit|paid with"), "bank": _introduced_by("iban|account|acct|bank|bic|konto|transfer"),
    "host": _introduced_by("ip|host|server|addr|address|peer|client|gateway"), "mail": _introduced_by("e-?mail|mail|write"),
}
#: Plan of the national numbers that are written in 3, 3 and 4 digits: area and exchange begin with 2 to 9 and don't end in 11.
NATIONAL = "^([2-9](?!11)[0-9]{2}){2}"
OF_KIND = tuple(f"kind_{k}" for k in KINDS)
OF_FORMAT = ("digits_10", "digits_14", "digits_to_15", "digits_to_19", "separated", "mixed", "both_cases", "octets", "luhn", "card_start", "mod97", "area", "national")
OF_CONTEXT = ("clear_before", "clear_after", *(f"{w}_word" for w in WORDS))
FLAGS = (*OF_KIND, *OF_FORMAT, *OF_CONTEXT)
#: What each set of trees may see.
VIEWS = ((*OF_KIND, *OF_CONTEXT), (*OF_KIND, *OF_FORMAT))


def _spans(text: Column, pattern: str) -> Column:
    """Matches as (start, end, value, before, after), left to right; positions by running sums in chunks."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.transform(F.sequence(F.lit(1), F.size(hits)), lambda i: F.struct(F.length(F.element_at(between, i)).alias("gap"), F.element_at(hits, i).alias("value"), F.right(F.element_at(between, i), F.lit(24)).alias("before"), F.left(F.element_at(between, i + 1), F.lit(2)).alias("after")))
    return F.when(F.size(hits) > 0, steps)


def _placed(steps: Column) -> Column:
    width = lambda s: s["gap"] + F.length(s["value"])
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda c: F.slice(steps, c * CHUNK + 1, CHUNK))
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + width(s)))
    starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    def place(chunk: Column, begin: Column) -> Column:
        step = lambda a, s: F.struct((a["at"] + width(s)).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + width(s)).alias("end"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after")))).alias("out"))
        return F.aggregate(chunk, F.struct(begin.alias("at"), none.alias("out")), step, lambda a: a["out"])

    return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), place))


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _described(kind: str, found: Column) -> Column:
    """(kind, start, end, strict, flags) of each placed match."""
    no, order = F.lit(False), KINDS.index(kind)

    def one(x: Column) -> Column:
        digits = F.regexp_replace(x["value"], "[^0-9]", "") if kind != "email" else F.lit("")
        n = F.length(digits)
        named = {w: x["before"].rlike(pattern) for w, pattern in WORDS.items()}
        word = F.lit(-1)
        for i in reversed(range(len(WORDS))):
            word = F.when(named[list(WORDS)[i]], i).otherwise(word)
        key, contact, security = named["key"], named["contact"], named["security"]
        octets = F.forall(F.split(x["value"], r"\."), lambda p: F.coalesce(F.try_to_number(F.right(F.concat(F.lit("0000"), F.regexp_replace(p, "^0+", "")), F.greatest(F.lit(4), F.length(F.regexp_replace(p, "^0+", "")))), F.lit("9999")) <= 255, no)) if kind == "ip" else no
        good_luhn = F.when(n.between(14, 19), luhn(digits)).otherwise(False) if kind == "card" else no
        area = ~digits.rlike("^(000|666|9|...00|.{5}0000)") if kind == "ssn" else no
        national = digits.rlike(NATIONAL) if kind == "tel" else no
        iban = mod97(F.replace(x["value"], F.lit(" "), F.lit(""))) if kind == "iban" else no
        strict = {"email": F.lit(True), "ip": octets, "card": good_luhn, "phone": n.between(10, 15), "tel": contact | national, "secret": key & x["value"].rlike("[A-Za-z]"), "ssn": area & security, "iban": iban}[kind]
        flags = {f"kind_{k}": F.lit(k == kind) for k in KINDS} | {
            "digits_10": n >= 10, "digits_14": n >= 14, "digits_to_15": n <= 15, "digits_to_19": n <= 19, "separated": x["value"].rlike(rf"[ ().{GROUP}-]"), "mixed": x["value"].rlike("[A-Za-z]") & x["value"].rlike("[0-9]"),
            "both_cases": x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]"), "octets": octets, "luhn": good_luhn, "card_start": digits.rlike("^[3-6]"), "mod97": iban, "area": area, "national": national,
            "clear_before": x["before"].rlike(r"(^|[\s\"'(|>:=,])$"), "clear_after": x["after"].rlike(r"^($|[\s\"')|<,.;:!?])"),
        }
        bits = F.lit(0)
        for k, name in enumerate(FLAGS):
            if name in flags:
                bits = bits + F.when(flags[name], 1 << k).otherwise(0)
        bits = bits + F.when(word >= 0, F.call_function("shiftleft", F.lit(1 << FLAGS.index("key_word")), word)).otherwise(0)
        return F.struct(F.lit(order).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.coalesce(strict, no).alias("strict"), bits.alias("flags"))

    return F.transform(found, one)


def candidates(docs: DataFrame, text_col: str = "text", out: str = "found") -> DataFrame:
    """`docs` with a last column of candidates of all kinds: array of (kind, start, end, strict, flags)."""
    own = [c for c in docs.columns if c != out]
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), GROUP + DOT, OTHER + OTHER)
    table = docs.select(*own, text.alias("plain_"))
    gated = {k: F.col("plain_").rlike(g) for k, g in GATES.items()}
    table = table.select(
        *own, "plain_",
        F.when(gated["email"], F.regexp_replace("plain_", rf"(?<=[{LABEL_CHARS}])\.(?=[{LABEL_CHARS}])", DOT)).alias("dotted_"),
        F.when(gated["card"], F.regexp_replace("plain_", "(?<=[0-9])[ -](?=[0-9])", GROUP)).alias("grouped_"),
    )
    table = table.select(*own, *[(F.when(gated[k], _spans(F.col(f"{name}_"), pattern)) if name == "plain" else _spans(F.col(f"{name}_"), pattern)).alias(f"{k}_") for k, (name, pattern) in PATTERNS.items()])
    table = table.select(*own, *[F.when(F.col(f"{k}_").isNotNull(), _placed(F.col(f"{k}_"))).alias(f"{k}_") for k in KINDS])
    none = F.array().cast("array<struct<kind:int,start:int,end:int,strict:boolean,flags:int>>")
    return table.select(*own, F.concat(*[F.coalesce(_described(k, F.col(f"{k}_")), none) for k in KINDS]).alias(out))


class Trees:
    """Boosted trees of two levels over the flags of one view, fitted on counts of right and all candidates by flag word."""

    def __init__(self, flags: np.ndarray, right: np.ndarray, total: np.ndarray, view: tuple[str, ...] = FLAGS):
        self.trees: list[tuple] = []
        n = max(1.0, float(total.sum()))
        rate = min(max(float(right.sum()) / n, 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        seen = np.array([FLAGS.index(name) for name in view])
        bits = (flags[:, None] >> seen & 1).astype(bool)
        value = np.full(len(flags), self.base)
        for _ in range(TREES if len(flags) else 0):
            p = 1 / (1 + np.exp(-value))
            slope, curve = right - total * p, total * p * (1 - p)
            root = self._best(bits, slope, curve, np.ones(len(flags), bool))
            leaves = []
            for side in (False, True):
                at = bits[:, root] == side
                below = self._best(bits, slope, curve, at)
                for end in (False, True):
                    leaf = at & (bits[:, below] == end)
                    step = RATE * float(slope[leaf].sum() / (curve[leaf].sum() + RIDGE))
                    value[leaf] += step
                    leaves.append((int(seen[below]), step))
            self.trees.append((int(seen[root]), leaves))

    def value_of(self, flags: np.ndarray) -> np.ndarray:
        """The probability of each flag word."""
        on = lambda k: (flags >> k & 1).astype(bool)
        total = np.full(len(flags), self.base)
        for root, ((left, a), (_, b), (right, c), (_, d)) in self.trees:
            total += np.where(on(root), np.where(on(right), d, c), np.where(on(left), b, a))
        return 1 / (1 + np.exp(-total))

    @staticmethod
    def _best(bits: np.ndarray, slope: np.ndarray, curve: np.ndarray, at: np.ndarray) -> int:
        on = bits & at[:, None]
        gain = lambda s, c: s**2 / (c + RIDGE)
        s1, c1 = slope @ on, curve @ on
        return int(np.argmax(gain(s1, c1) + gain(slope[at].sum() - s1, curve[at].sum() - c1)))

    def probability(self, flags: Column) -> Column:
        """The same sum as a column over a flag word."""
        on = lambda k: flags.bitwiseAND(F.lit(1 << k)) != 0
        total = F.lit(self.base)
        for root, ((left, a), (_, b), (right, c), (_, d)) in self.trees:
            total = total + F.when(on(root), F.when(on(right), d).otherwise(c)).otherwise(F.when(on(left), b).otherwise(a))
        return 1 / (1 + F.exp(-total))


def _thresholds(value: np.ndarray, kind: np.ndarray, fitted: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray], least: int) -> list[float]:
    """Each kind's lowest threshold whose selected candidates are `least` at least and right to PRECISION; 2 if there is none.

    fitted, held: (right, all) by flag word.
    """
    out = []
    for k in range(len(KINDS)):
        own = kind == k
        (g, n), (g_held, n_held) = ((right[own], total[own]) for right, total in (fitted, held))
        if not (n_held.sum() and g_held.sum()):
            g_held, n_held = g + g_held, n + n_held
        order = np.argsort(-value[own], kind="stable")
        ranked, hits, count = value[own][order], np.cumsum(g_held[order]), np.cumsum(n_held[order])
        last = np.append(ranked[1:] != ranked[:-1], True) if len(ranked) else np.zeros(0, bool)
        fine = np.flatnonzero(last & (hits >= PRECISION * count) & (hits >= least))
        out.append(float(ranked[fine[-1]]) - 1e-9 if len(fine) else 2.0)
    return out


def co_train(kind: np.ndarray, flags: np.ndarray, fitted: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray]) -> tuple[Trees, list[float]]:
    """Trees over all flags and each kind's threshold. fitted, held: (strict, all) counts by flag word, of documents for the trees and for the thresholds.

    A view's labels are the strict ones and, from the second round on, the flag words that the other view selected in the round
    before, with EVIDENCE; the last trees take the strict labels and what either view selected.
    """
    known = fitted[1] > 0

    def taught(by: np.ndarray, view: tuple[str, ...], least: int) -> tuple[Trees, list[float], np.ndarray]:
        labels = [(np.where(by, total, right), total) for right, total in (fitted, held)]
        trees = Trees(flags[known], labels[0][0][known].astype(float), labels[0][1][known].astype(float), view)
        value = trees.value_of(flags)
        limits = _thresholds(value, kind, *labels, least)
        return trees, limits, value >= np.array(limits)[kind]

    chosen = [np.zeros(len(flags), bool) for _ in VIEWS]
    for _ in range(ROUNDS):
        chosen = [taught(other, view, EVIDENCE)[2] for view, other in zip(VIEWS, reversed(chosen), strict=True)]
    trees, limits, _ = taught(np.logical_or(*chosen), FLAGS, 1)
    return trees, limits


def fit(found: DataFrame, column: str, held_out: Column) -> tuple[Trees, list[float]]:
    """Trees, and each kind's threshold, from the candidates in `column`. Counts of all documents, a row a flag word.

    held_out: whether a row's document serves for the thresholds alone.
    """
    exploded = found.select(held_out.alias("held"), F.explode(column).alias("c"))
    right, every = F.col("c.strict").cast("long"), F.lit(1)
    of = lambda v, held: F.sum(F.when(F.col("held") == held, v).otherwise(0))
    cells = exploded.groupBy("c.kind", "c.flags").agg(of(right, False).alias("right"), of(every, False).alias("total"), of(right, True).alias("right_held"), of(every, True).alias("total_held"))
    rows = sorted(cells.collect())
    kind, flags, good, seen, good_held, seen_held = (np.array([r[k] for r in rows], np.int64) for k in range(6))
    return co_train(kind, flags, (good, seen), (good_held, seen_held))


def with_spans(table: DataFrame, column: str, trees: Trees, thresholds: list[float]) -> DataFrame:
    """`table` with the candidates in `column` replaced by base_, more_ and every_: arrays of (start, kind, end), by start and kind.

    more_: the added spans that pass no strict check.
    """
    kept = [c for c in table.columns if c not in (column, "base_", "more_", "every_")]
    is_base = lambda s: s["strict"] & (s["kind"] < len(BASE))
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    limit = F.array(*[F.lit(t) for t in thresholds])
    good = lambda s: ~is_base(s) & (trees.probability(s["flags"]) >= F.element_at(limit, s["kind"] + 1))
    split = table.select(*kept, F.transform(F.filter(column, is_base), plain).alias("base_"), F.filter(column, good).alias("more_"))
    free = lambda s: ~F.exists("base_", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    split = split.select(*kept, "base_", F.filter("more_", free).alias("more_"))
    unchecked = F.transform(F.filter("more_", lambda s: ~s["strict"]), plain)
    return split.select(*kept, F.array_sort("base_").alias("base_"), F.array_sort(unchecked).alias("more_"), F.array_sort(F.concat("base_", F.transform("more_", plain))).alias("every_"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _is_kind(k: int, s: Column) -> Column:
    return s["kind"] == k


def _held(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(HELD_OUT)) == 0


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of the contract for each row of `docs`, the number of all spans and of those that no strict check names."""
    found = cut(candidates(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))).select("key", "found"))
    trees, thresholds = fit(found, "found", _held(F.col("key")))
    spans = with_spans(found, "found", trees, thresholds)
    counts = [F.size(F.filter("base_", partial(_is_kind, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return spans.select(F.col("key").alias(id_col), *counts, F.sha2(written(F.col("base_")), 256).alias("base_sha256"), written(F.col("every_")).alias("spans"), F.size("every_").cast("long").alias("n_spans"), F.size("more_").cast("long").alias("n_unchecked"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with each span of its text replaced by [KIND]; spans that overlap are replaced together, by the first one's kind.

    The columns of `docs` travel in one struct, so that none of their names can clash with those used here.
    """
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(quoted(text_col)).cast("string").alias("text"))
    found = cut(candidates(whole))
    trees, thresholds = fit(found, "found", _held(F.col("text")))
    spans = with_spans(found, "found", trees, thresholds).select("row", "text", F.col("every_").alias("spans"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(F.col("text"), a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"])), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(piece))).alias("out"))

    spans = spans.select("row", "text", F.when(F.size("spans") > 0, F.aggregate("spans", start, step)).alias("cut"))
    new = F.concat(F.array_join(F.col("cut")["out"], ""), F.substring(F.col("text"), F.col("cut")["at"] + 1, F.length("text")))
    of = lambda c: F.col("row").getField(c)
    return spans.select(*[F.when(F.col("cut").isNull(), of(c)).otherwise(new).alias(c) if c == text_col else of(c).alias(c) for c in docs.columns])
