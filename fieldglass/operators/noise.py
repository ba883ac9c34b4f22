"""Corruptions of form-like text as Column expressions, their weighted selection, and the check of what is left.

Every function takes a text and a key; all choices follow from hashes of the key, so a text is corrupted alike in every run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import below, between, by_weight, let, lines, pick, strip, uniform, unlines
from .domains import DOMAINS, EXTRA_LINES, NOISE_COUNTS, NOISE_DOMAINS, NOISE_RATES, NOISE_WEIGHTS, fields

# Confusable characters, neighbours on the keyboard, and replacements.
CONFUSED = {"char_O0": ("O0", "0O"), "char_l1I": ("l1I", "1Il"), "char_B8": ("B8", "8B"), "char_S5": ("S5", "5S")}
NEARBY = {
    "a": "sq", "b": "vn", "c": "xv", "d": "sf", "e": "wr", "f": "dg", "g": "fh", "h": "gj", "i": "uo", "j": "hk", "k": "jl", "l": "k", "m": "n",
    "n": "mb", "o": "ip", "p": "o", "q": "wa", "r": "et", "s": "ad", "t": "ry", "u": "yi", "v": "cb", "w": "qe", "x": "cz", "y": "tu", "z": "x",
}
DELIMITERS = ["-", "/", " ", " - ", " / "]
ERASED = ["", "???", "----", "XXXXX", "......"]
VAGUE = ["Ref No", "Date", "Number", "ID", "Code", "No", "Details"]
OFFSETS = [-1000, -500, 500, 1000, -100, 100]
DATE_TARGETS = ["dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd-MMM-yyyy", "ddMMyyyy", "MM-dd-yy", "dd/MM/yy"]
DATE_SOURCES = [(r"\b\d{2}/\d{2}/\d{4}\b", "dd/MM/yyyy"), (r"\b\d{2}-\d{2}-\d{4}\b", "dd-MM-yyyy"), (r"\b\d{2} [A-Za-z]{3} \d{4}\b", "dd MMM yyyy"), (r"\b\d{2}/\d{2}/\d{2}\b", "dd/MM/yy")]
PARTIAL_DATE = r"\b\d{2}[/-]\d{2}[/-]\d{2,4}\b"


def colon(line: Column) -> Column:
    """Place of the first colon, from 1; 0 if there is none."""
    return F.locate(":", line)


def head(line: Column) -> Column:
    return F.substring(line, F.lit(1), colon(line))


def tail(line: Column) -> Column:
    return F.substring(line, colon(line) + 1, F.length(line))


def places(array: Column, holds: Callable[[Column], Column]) -> Column:
    """Indexes (from 0) of the elements for which `holds`."""
    return F.filter(F.transform(array, lambda x, i: F.when(holds(x), i)), lambda i: i.isNotNull())


def changed(array: Column, index: Column, new: Callable[[Column], Column]) -> Column:
    """The array with the element at an index replaced; as it is where the index is null."""
    return F.transform(array, lambda x, i: F.when(i == index, new(x)).otherwise(x))


def _labelled(line: Column) -> Column:
    return colon(line) > 0


def _rate(tag: str, *key) -> Column:
    low, high = NOISE_RATES[tag]
    return F.lit(low) + uniform(*key, tag, "rate") * (high - low)


def confuse(tag: str) -> Callable[[Column, Column], Column]:
    """Each of a few characters turns into its look-alike with the text's rate, labels included."""
    here, there = CONFUSED[tag]

    def run(text: Column, key: Column) -> Column:
        return let(_rate(tag, key), lambda rate: F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.isin(*here) & (uniform(key, tag, i) < rate), F.translate(c, here, there)).otherwise(c)), ""))

    return run


def _each_line(text: Column, new: Callable[[Column, Column], Column]) -> Column:
    return unlines(F.transform(lines(text), new))


def char_sub(text: Column, key: Column) -> Column:
    """One or two letters of each value become neighbours on the keyboard."""
    count = between(1, 2, key, "char_sub", "n")
    letters = F.create_map(*[F.lit(x) for kv in NEARBY.items() for x in kv])

    def one(line: Column, i: Column, turn: int) -> Column:
        chars = F.split(line, "")
        at = pick(F.filter(F.sequence(F.lit(1), F.length(line)), lambda p: (p > colon(line)) & F.substring(line, p, F.lit(1)).rlike("[A-Za-z]")), key, "char_sub", i, turn)
        c = F.element_at(chars, at)
        near = let(F.element_at(letters, F.lower(c)), lambda n: F.substring(n, below(F.length(n), key, "char_sub", i, turn, "to") + 1, F.lit(1)))
        return F.when(at.isNull(), line).otherwise(F.overlay(line, F.when(c.rlike("[A-Z]"), F.upper(near)).otherwise(near), at, F.lit(1)))

    first = lambda line, i: F.when(line == "", line).otherwise(one(line, i, 1))
    return _each_line(text, lambda line, i: let(first(line, i), lambda x: F.when((count > 1) & (x != ""), one(x, i, 2)).otherwise(x)))


def _inner(line: Column, holds: str) -> Column:
    """Places within the value at which the next, this and the former character match a pattern of three."""
    span = F.when(F.length(line) - colon(line) >= 2, F.sequence(colon(line) + 1, F.length(line) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(span, lambda p: F.substring(line, p - 1, F.lit(3)).rlike(holds) & (p > 1))


def char_del(text: Column, key: Column) -> Column:
    """One letter inside a word of each value goes."""
    return _each_line(text, lambda line, i: let(pick(_inner(line, "^[^ ][A-Za-z][^ ]$"), key, "char_del", i), lambda p: F.when(p.isNull(), line).otherwise(F.concat(F.substring(line, F.lit(1), p - 1), F.substring(line, p + 1, F.length(line))))))


def char_transpose(text: Column, key: Column) -> Column:
    """Two neighbouring letters of each value change places."""
    swap = lambda line, p: F.concat(F.substring(line, F.lit(1), p - 1), F.substring(line, p + 1, F.lit(1)), F.substring(line, p, F.lit(1)), F.substring(line, p + 2, F.length(line)))
    return _each_line(text, lambda line, i: let(pick(_inner(line, "^.?[A-Za-z][A-Za-z]$"), key, "char_transpose", i), lambda p: F.when(p.isNull(), line).otherwise(swap(line, p))))


def missing_colon(text: Column, key: Column) -> Column:
    """Some lines lose their first colon, a space stands for it."""
    rate = _rate("missing_colon", key)
    return _each_line(text, lambda line, i: F.when((line != "") & (uniform(key, "missing_colon", i) < rate), F.regexp_replace(line, r"^([^:]*?)\s*:\s*", "$1 ")).otherwise(line))


def merged_lines(text: Column, key: Column) -> Column:
    """Once or twice, two neighbouring lines become one."""

    def once(array: Column, turn: int) -> Column:
        pairs = F.filter(F.transform(array, lambda x, i: F.when((strip(x) != "") & (strip(F.coalesce(F.get(array, i + 1), F.lit(""))) != ""), i)), lambda i: i.isNotNull())
        join = lambda at: F.concat(F.slice(array, F.lit(1), at), F.array(F.concat(F.get(array, at), F.lit(" "), F.get(array, at + 1))), F.slice(array, at + 3, F.size(array)))
        return let(pick(pairs, key, "merged_lines", turn), lambda at: F.when(at.isNull(), array).otherwise(join(at)))

    twice = between(1, 2, key, "merged_lines", "n") == 2
    return let(lines(text), lambda a: let(once(a, 1), lambda b: unlines(F.when(twice, once(b, 2)).otherwise(b))))


def split_line(text: Column, key: Column) -> Column:
    """A value of several words goes on in a line of its own."""

    def cut(line: Column) -> Column:
        words = F.split(strip(tail(line)), r"\s+")
        at = 1 + below(F.size(words) - 1, key, "split_line", "at")
        return F.concat(head(line), F.lit(" "), F.array_join(F.slice(words, F.lit(1), at), " "), F.lit("\n"), F.array_join(F.slice(words, at + 1, F.size(words)), " "))

    able = lambda line: _labelled(line) & strip(tail(line)).rlike(r"\S\s+\S")
    return let(lines(text), lambda a: let(pick(places(a, able), key, "split_line"), lambda at: unlines(changed(a, at, cut))))


def key_abbrev(text: Column, key: Column, domain: str) -> Column:
    """Some labels give way to a variant that isn't longer. Off unless asked for: selection draws it, nothing applies it."""
    rate = _rate("key_abbrev", key)
    known = {f.labels[0].lower(): [v for v in f.labels[1:] if len(v) <= len(f.labels[0])] for f in fields(domain)}
    table = F.create_map(*[x for k, vs in known.items() if vs for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]))])
    name = lambda line: strip(F.substring(line, F.lit(1), colon(line) - 1))

    def one(line: Column, i: Column) -> Column:
        short = pick(F.try_element_at(table, F.lower(name(line))), key, "key_abbrev", i, "to")
        return F.when(_labelled(line) & (uniform(key, "key_abbrev", i) < rate) & short.isNotNull(), F.concat(short, F.substring(line, colon(line), F.length(line)))).otherwise(line)

    return _each_line(text, one)


def value_truncated(text: Column, key: Column) -> Column:
    """One value of over 5 characters is cut to between 50 and 80 percent."""
    value = lambda line: F.when(_labelled(line), strip(tail(line))).otherwise(line)

    def cut(line: Column) -> Column:
        n = F.length(value(line))
        low, high = F.floor(n * 0.5).cast("int"), F.floor(n * 0.8).cast("int")
        return F.concat(head(line), F.lit(" "), F.substring(value(line), F.lit(1), low + below(high - low + 1, key, "value_truncated", "cut")))

    return let(lines(text), lambda a: let(pick(places(a, lambda x: F.length(value(x)) > 5), key, "value_truncated"), lambda at: unlines(changed(a, at, cut))))


def delimiter_swap(text: Column, key: Column) -> Column:
    """The first colon of one or two lines becomes another delimiter."""
    count = between(1, 2, key, "delimiter_swap", "n")

    def run(a: Column) -> Column:
        order = F.array_sort(F.transform(places(a, _labelled), lambda i: F.struct(uniform(key, "delimiter_swap", i).alias("o"), i.alias("i"))))
        chosen = F.transform(F.slice(order, F.lit(1), count), lambda s: s["i"])
        to = lambda i: pick(DELIMITERS, key, "delimiter_swap", i, "to")
        left, right = (lambda x: F.regexp_extract(x, r"^([^:]*?)\s*:\s*(.*)$", 1)), (lambda x: F.regexp_extract(x, r"^([^:]*?)\s*:\s*(.*)$", 2))
        return let(chosen, lambda c: unlines(F.transform(a, lambda x, i: F.when(F.array_contains(c, i), F.concat(left(x), to(i), right(x))).otherwise(x))))

    return let(lines(text), run)


def num_comma_drop(text: Column, key: Column) -> Column:
    """Numbers lose the commas between their digits."""
    return F.regexp_replace(text, r"(?<=\d),(?=\d{2,3})", "")


def _each_match(text: Column, pattern: str, new: Callable[[Column, Column], Column]) -> Column:
    """Every match of a pattern (of one shape) replaced by `new` of it and its number."""
    found, rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    return let(F.struct(found.alias("f"), rest.alias("r")), lambda s: F.array_join(F.flatten(F.transform(s["r"], lambda x, i: F.array(x, F.coalesce(F.when(i < F.size(s["f"]), new(F.get(s["f"], i), i)), F.lit(""))))), ""))


def num_decimal_shift(text: Column, key: Column) -> Column:
    """Each decimal number is multiplied or divided by ten; it keeps its count of decimals, the last one rounded half up. The
    point moves in the digits, which may be any number."""

    def plain(whole: Column, rest: Column) -> Column:
        whole = F.regexp_replace(whole, "^0+(?=.)", "")
        return F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("."), rest)

    def larger(digits: Column) -> Column:
        """Digits plus one in the last place."""
        nines = F.length(F.regexp_extract(digits, "9*$", 0))
        kept = F.substring(digits, F.lit(1), F.length(digits) - nines)
        up = F.concat(F.substring(kept, F.lit(1), F.length(kept) - 1), F.translate(F.substring(kept, -1, 1), "012345678", "123456789"))
        return F.concat(F.when(kept == "", "1").otherwise(up), F.repeat(F.lit("0"), nines))

    def divided(whole: Column, rest: Column) -> Column:
        digits = F.concat(F.lit("0"), whole, rest)
        cut = F.substring(digits, F.lit(1), F.length(digits) - 1)
        rounded = F.when(F.substring(digits, -1, 1) >= "5", larger(cut)).otherwise(cut)
        return let(rounded, lambda d: plain(F.substring(d, F.lit(1), F.length(d) - F.length(rest)), F.substring(d, F.length(d) - F.length(rest) + 1, F.length(rest))))

    def shifted(x: Column, i: Column) -> Column:
        whole, rest = F.substring_index(x, ".", 1), F.substring_index(x, ".", -1)
        more = plain(F.concat(whole, F.substring(rest, 1, 1)), F.concat(F.substring(rest, F.lit(2), F.length(rest)), F.lit("0")))
        return F.when(uniform(key, "num_decimal_shift", i) < 0.5, divided(whole, rest)).otherwise(more)

    return _each_match(text, r"\b\d+\.\d+\b", shifted)


def date_format_vary(text: Column, key: Column) -> Column:
    """Dates in four notations, one after the other, turn into one of seven."""

    def vary(n: int, source: str) -> Callable[[Column, Column], Column]:
        def one(x: Column, i: Column) -> Column:
            day = F.try_to_date(x, source)
            which = below(len(DATE_TARGETS), key, "date_format_vary", n, i)
            to = F.date_format(day, DATE_TARGETS[0])
            for k, f in enumerate(DATE_TARGETS[1:], 1):
                to = F.when(which == k, F.date_format(day, f)).otherwise(to)
            return F.coalesce(to, x)

        return one

    def after(n: int, text: Column) -> Column:
        if n == len(DATE_SOURCES):
            return text
        pattern, source = DATE_SOURCES[n]
        return let(_each_match(text, pattern, vary(n, source)), lambda t: after(n + 1, t))

    return after(0, text)


def date_partial(text: Column, key: Column) -> Column:
    """One digit of one date turns into a look-alike letter, if it has one."""

    def run(n: Column) -> Column:
        which = below(F.greatest(n, F.lit(1)), key, "date_partial")

        def spoil(x: Column, i: Column) -> Column:
            at = pick(F.filter(F.sequence(F.lit(1), F.length(x)), lambda p: F.substring(x, p, F.lit(1)).rlike(r"\d")), key, "date_partial", "digit")
            return F.when(i == which, F.overlay(x, F.translate(F.substring(x, at, F.lit(1)), "0815", "OBlS"), at, F.lit(1))).otherwise(x)

        return _each_match(text, PARTIAL_DATE, spoil)

    return let(F.size(F.regexp_extract_all(text, F.lit(PARTIAL_DATE), F.lit(0))), run)


def extraneous_field(text: Column, key: Column, domain: str) -> Column:
    """One or two lines that belong to no field are added."""
    pool = F.array(*[F.struct(uniform(key, "extraneous_field", i).alias("o"), F.lit(x).alias("x")) for i, x in enumerate(EXTRA_LINES[domain])])
    return F.concat(text, F.lit("\n"), F.array_join(F.transform(F.slice(F.array_sort(pool), F.lit(1), between(1, 2, key, "extraneous_field", "n")), lambda s: s["x"]), "\n"))


def scramble(value: Column, *key) -> Column:
    """A plausible wrong value: numbers move by an offset, dates by a digit, longer texts are shuffled inside, others grow."""
    n = F.replace(value, F.lit(","), F.lit("")).try_cast("double")
    offset = F.element_at(F.array(*[F.lit(o) for o in OFFSETS]), below(len(OFFSETS), *key, "offset") + 1)
    at = pick(F.filter(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda p: F.substring(value, p, F.lit(1)).rlike(r"\d")), *key, "digit")
    digit = ((F.substring(value, at, F.lit(1)).try_cast("int") + between(1, 5, *key, "plus")) % 10).cast("string")
    inner = F.split(F.substring(value, F.lit(2), F.length(value) - 2), "")
    mixed = F.array_join(F.transform(F.array_sort(F.transform(inner, lambda c, i: F.struct(uniform(*key, "mid", i).alias("o"), c.alias("c")))), lambda s: s["c"]), "")
    return (
        F.when(F.replace(value, F.lit(" "), F.lit("")).rlike(r"^[\d,.]+$") & n.isNotNull(), (n + offset).cast("long").cast("string"))
        .when(value.rlike(r"^\d{2}[/-]\d{2}[/-]\d{2,4}"), F.overlay(value, digit, at, F.lit(1)))
        .when(F.length(value) > 4, F.concat(F.substring(value, 1, 1), mixed, F.substring(value, -1, 1)))
        .otherwise(F.concat(value, F.lit("X")))
    )


def ghost_value(text: Column, key: Column) -> Column:
    """One value is replaced by a scrambled one."""
    ghost = lambda line: F.concat(head(line), F.lit(" "), scramble(strip(tail(line)), key, "ghost_value"))
    return let(lines(text), lambda a: let(pick(places(a, _labelled), key, "ghost_value", "line"), lambda at: unlines(changed(a, at, ghost))))


def conflicting_field(text: Column, key: Column) -> Column:
    """A label comes again further down with a scrambled value."""

    def run(a: Column, at: Column) -> Column:
        line = F.get(a, at)
        new = F.concat(head(line), F.lit(" "), scramble(strip(tail(line)), key, "conflicting_field"))
        to = at + 1 + below(F.size(a) - at, key, "conflicting_field", "to")
        return F.concat(F.slice(a, F.lit(1), to), F.array(new), F.slice(a, to + 1, F.size(a)))

    return let(lines(text), lambda a: let(pick(places(a, _labelled), key, "conflicting_field", "line"), lambda at: unlines(F.when(at.isNull(), a).otherwise(run(a, at)))))


def ambiguous_key(text: Column, key: Column) -> Column:
    """One label becomes a vague one."""
    vague = lambda line: F.concat(pick(VAGUE, key, "ambiguous_key", "to"), F.substring(line, colon(line), F.length(line)))
    return let(lines(text), lambda a: let(pick(places(a, _labelled), key, "ambiguous_key"), lambda at: unlines(changed(a, at, vague))))


def value_swap(text: Column, key: Column) -> Column:
    """Two labelled lines change values."""

    def run(a: Column) -> Column:
        order = F.array_sort(F.transform(places(a, _labelled), lambda i: F.struct(uniform(key, "value_swap", i).alias("o"), i.alias("i"))))
        swap = lambda o: F.transform(a, lambda x, i: F.when(i == o[0]["i"], F.concat(head(x), tail(F.get(a, o[1]["i"])))).when(i == o[1]["i"], F.concat(head(x), tail(F.get(a, o[0]["i"])))).otherwise(x))
        return let(order, lambda o: F.when(F.size(o) < 2, a).otherwise(swap(o)))

    return let(lines(text), lambda a: unlines(run(a)))


def section_erase(text: Column, key: Column) -> Column:
    """Two to four labelled lines in a row lose their values."""

    def run(a: Column, able: Column) -> Column:
        size = F.lit(2) + below(F.least(F.lit(4), F.size(able)) - 1, key, "section_erase", "n")
        gone = F.slice(able, below(F.size(able) - size + 1, key, "section_erase", "at") + 1, size)
        return F.transform(a, lambda x, i: F.when(F.array_contains(gone, i), F.concat(head(x), F.lit(" "), pick(ERASED, key, "section_erase", i))).otherwise(x))

    return let(lines(text), lambda a: let(places(a, _labelled), lambda able: unlines(F.when(F.size(able) < 2, a).otherwise(run(a, able)))))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    **{tag: confuse(tag) for tag in CONFUSED},
    **{f.__name__: f for f in (char_sub, char_del, char_transpose, missing_colon, merged_lines, split_line, value_truncated, delimiter_swap, num_comma_drop, num_decimal_shift, date_format_vary, date_partial, ghost_value, conflicting_field, ambiguous_key, value_swap, section_erase)},
}
BY_DOMAIN: dict[str, Callable[..., Column]] = {"extraneous_field": extraneous_field, "key_abbrev": key_abbrev}


def apply(tag: str, text: Column, key: Column, domain: str = "receipts") -> Column:
    return BY_DOMAIN[tag](text, key, domain) if tag in BY_DOMAIN else FUNCTIONS[tag](text, key)


def _weights(tier: int, domain: str) -> dict[str, float]:
    return {t: w for t, w in NOISE_WEIGHTS[tier].items() if domain in NOISE_DOMAINS.get(t, [domain])}


def select(difficulty: Column, domain: str, *key) -> Column:
    """Tags in order of application: tiers 1 and 2 without replacement (by -ln(u) / weight), tiers 3 and 4 with."""
    count = lambda tier: F.coalesce(*[F.when(difficulty == d, F.lit(c[tier][0]) + below(c[tier][1] - c[tier][0] + 1, *key, "count", tier)) for d, c in NOISE_COUNTS.items()])
    first = F.array(*[F.struct((-F.log(uniform(*key, "tag", t) + 1e-12) / w).alias("o"), F.lit(t).alias("t")) for t, w in _weights(0, domain).items()])
    out = [F.transform(F.slice(F.array_sort(first), F.lit(1), count(0)), lambda s: s["t"])]
    for tier in (1, 2):
        n = count(tier)
        most = max(c[tier][1] for c in NOISE_COUNTS.values())
        drawn = F.array(*[by_weight(_weights(tier, domain), *key, "tier", tier, i) for i in range(most)])
        out.append(F.slice(drawn, F.lit(1), n))
    return F.concat(*out)


def survive(text: Column, labels: list[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for label in labels:
        out = out | F.contains(low, F.lit(label.lower()))
    return out


def valid(raw: Column, text: Column, difficulty: Column, domain: str) -> Column:
    """Easy and medium texts keep a label of every required field, extreme ones lose all labels of one; all but easy change."""
    kept = [survive(text, list(f.labels)) for f in fields(domain) if f.required]
    everything = kept[0]
    for k in kept[1:]:
        everything = everything & k
    return ((difficulty == "easy") | (raw != text)) & (~difficulty.isin("easy", "medium") | everything) & ((difficulty != "extreme") | ~everything)


def corrupt(samples: DataFrame, seed: int = 42, attempts: int = 5, with_abbrev: bool = False) -> DataFrame:
    """Adds ocr_text, noise_tags and noise_valid to samples (id, domain, difficulty, raw_text): up to `attempts` draws, of which
    the first valid one stands, else the last."""
    state = "struct<text: string, tags: array<string>, ok: boolean>"

    def attempt(domain: str, n: Column) -> Column:
        key = F.concat_ws("-", F.lit(seed), F.col("id"), n)

        def step(acc: Column, tag: Column) -> Column:
            out = acc
            for t in (t for tier in range(3) for t in _weights(tier, domain)):
                if t != "key_abbrev" or with_abbrev:
                    out = F.when(tag == t, apply(t, acc, key, domain)).otherwise(out)
            return out

        run = lambda tags: F.struct(F.aggregate(tags, F.col("raw_text"), step).alias("text"), F.filter(tags, lambda t: (t != "key_abbrev") | F.lit(with_abbrev)).alias("tags"))
        done = let(select(F.col("difficulty"), domain, key), run)
        return let(done, lambda d: F.struct(d["text"].alias("text"), d["tags"].alias("tags"), valid(F.col("raw_text"), d["text"], F.col("difficulty"), domain).alias("ok")).cast(state))

    def until_valid(domain: str) -> Callable[[Column, Column], Column]:
        return lambda acc, n: F.when(F.coalesce(acc["ok"], F.lit(False)), acc).otherwise(attempt(domain, n))

    out = None
    for domain in DOMAINS:
        drawn = F.aggregate(F.sequence(F.lit(1), F.lit(attempts)), F.lit(None).cast(state), until_valid(domain))
        part = samples.where(F.col("domain") == domain).withColumn("_noise", drawn)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("ocr_text", F.col("_noise.text")).withColumn("noise_tags", F.col("_noise.tags")).withColumn("noise_valid", F.col("_noise.ok")).drop("_noise")
