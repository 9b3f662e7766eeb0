"""Secret scans with DataFrame functions only: rules, and entropy in sliding windows."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name

# Fixed values of the rules, in the order in which spans of one start are listed.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
#: A candidate string of the entropy rules, and the symbols of its characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Candidates that are no secrets: UUIDs, digests with their algorithm's name, samples, plain sequences.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(sha1|sha256|sha384|sha512|md5)[-=_]",
    r"(?i)example|sample|placeholder|changeme|dummy",
    r"(?i)0123456789|abcdefghij|(xx){4}|(00){5}",
)

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body) -> Column:
    """body(x) for x = value, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, weight, join, zero: Column, emit) -> Column:
    """emit(item, state) for every item, where state joins zero and the weights of all items before; items isn't empty.

    The items are cut into about as many blocks as a block has items, so the work is items
    times their root, not their square.
    """
    total = lambda part, first: F.aggregate(part, first, lambda acc, x: join(acc, weight(x)))

    def of_blocks(blocks: Column, sums: Column) -> Column:
        def block(part: Column, b: Column) -> Column:
            first = F.aggregate(F.slice(sums, 1, b), zero, lambda acc, x: join(acc, x))
            return let(first, lambda start: F.transform(part, lambda x, i: emit(x, total(F.slice(part, 1, i), start))))

        return F.flatten(F.transform(blocks, block))

    def cut(whole: Column, size: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(whole) - 1) / size).cast("int")), lambda b: F.slice(whole, b * size + 1, size))
        return let(blocks, lambda parts: let(F.transform(parts, lambda part: total(part, zero)), lambda sums: of_blocks(parts, sums)))

    return let(items, lambda whole: let(F.ceil(F.sqrt(F.size(whole))).cast("int"), lambda size: cut(whole, size)))


def matches(text: Column, pattern: str) -> Column:
    """All matches with their places: array of (start, end, hit, value), start and end in code points.

    What lies between the matches gives the places; value is group 2 if there is one.
    """
    group = 2 if ")[" in pattern else 0
    each = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")
    )

    def placed(x: Column, before: Column) -> Column:
        start = before + F.length(x["gap"])
        return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), x["value"].alias("value"))

    found = scan(F.filter(each, lambda x: x["hit"].isNotNull()), lambda x: F.length(x["gap"]) + F.length(x["hit"]), lambda a, b: a + b, F.lit(0), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string,value:string>>"))


def spans_of(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def entropy_windows(candidate: Column, window: int, bits: float) -> Column:
    """Runs of windows whose Shannon entropy is at least bits: array of (start, end) in the candidate.

    One fold over the characters. The state holds the count of each symbol in the window
    and s = sum of c * log2(c); a character that enters or leaves changes one count and two
    terms of s. The entropy is log2(window) - s / window. Windows that overlap are joined.
    """
    terms = F.array(*(F.lit(c * log2(c) if c else 0.0) for c in range(window + 2)))
    most = window * (log2(window) - bits)
    runs = "array<struct<start:int,end:int>>"
    symbols = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(SYMBOLS), c))
    term = lambda c: F.get(terms, c)
    count = lambda counts, x: F.coalesce(F.get(counts, x), F.lit(0))

    def step(acc: Column, chars: Column) -> Column:
        i = acc["i"]
        new, old = F.get(chars, i), F.coalesce(F.get(chars, i - window), F.lit(-1))

        def shifted(x: Column) -> Column:
            enters, leaves = count(acc["counts"], x["new"]), count(acc["counts"], x["old"]) + F.when(x["old"] == x["new"], 1).otherwise(0)
            return F.struct(
                F.transform(acc["counts"], lambda c, k: c + F.when(k == x["new"], 1).otherwise(0) - F.when(k == x["old"], 1).otherwise(0)).alias("counts"),
                (acc["s"] + term(enters + 1) - term(enters) + F.when(x["old"] >= 0, term(leaves - 1) - term(leaves)).otherwise(0.0)).alias("s"),
            )

        def told(x: Column) -> Column:
            hit = (i >= window - 1) & (x["s"] <= most)
            joins = hit & (acc["end"] >= i - window + 1)
            return F.struct(
                (i + 1).alias("i"),
                x["counts"].alias("counts"),
                x["s"].alias("s"),
                F.when(hit & ~joins, i - window + 1).otherwise(acc["start"]).alias("start"),
                F.when(hit, i + 1).otherwise(acc["end"]).alias("end"),
                F.when(hit & ~joins & (acc["end"] >= 0), F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"]).alias("out"),
            )

        return let(F.struct(new.alias("new"), old.alias("old")), lambda x: let(shifted(x), told))

    start = F.struct(
        F.lit(0).alias("i"),
        F.array_repeat(F.lit(0), len(SYMBOLS) + 1).alias("counts"),
        F.lit(0.0).alias("s"),
        F.lit(-1).alias("start"),
        F.lit(-1).alias("end"),
        F.array().cast(runs).alias("out"),
    )
    return let(
        symbols,
        lambda chars: F.aggregate(
            chars,
            start,
            lambda acc, _: step(acc, chars),
            lambda acc: F.when(acc["end"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"]),
        ),
    )


def entropy_spans(found: Column, window: int, hex_bits: float, base64_bits: float) -> Column:
    """Spans of the candidates' dense windows, by character class; allowed candidates give none."""
    is_hex = lambda x: x["hit"].rlike("^[0-9a-fA-F]+$")
    has_digit = lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]")
    allowed = lambda x: x["hit"].rlike("|".join(f"(?:{p})" for p in ALLOWED))

    def of(x: Column, kind: str, bits: float) -> Column:
        return F.transform(
            entropy_windows(x["hit"], window, bits),
            lambda w: F.struct((x["start"] + w["start"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (x["start"] + w["end"]).alias("end")),
        )

    wanted = F.filter(found, lambda x: has_digit(x) & ~allowed(x))
    return F.flatten(F.transform(wanted, lambda x: F.when(is_hex(x), of(x, "entropy_hex", hex_bits)).otherwise(of(x, "entropy_base64", base64_bits))))


def written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text_col: str = "text", window: int = 20, hex_bits: float = 3.0, base64_bits: float = 3.9, out: str = "secret_spans") -> DataFrame:
    """All columns of docs and out: array of (start, kind, end), sorted; kind is an index into KINDS.

    Rules first: assignments whose value has 6 characters or more, access keys, hex runs.
    Then candidate strings are scanned by entropy_windows for their character class, and a
    dense span that no rule's span covers is added. Null and empty texts have no spans.
    Everything is an expression over one row: no shuffle, no Python.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(x["value"]) >= 6)
    base = F.array_sort(F.concat(spans_of(assign, "assign"), spans_of(matches(text, ACCESS), "access"), spans_of(matches(text, HEX), "hex")))
    dense = entropy_spans(matches(text, CANDIDATE), window, hex_bits, base64_bits)

    def uncovered(spans: Column) -> Column:
        """Without dense spans that end within a rule's span that starts no later."""
        is_rule = lambda x: x["kind"] < KINDS.index("entropy_hex")
        told = lambda x, reach: F.struct(x.alias("span"), (is_rule(x) | (x["end"] > reach)).alias("stays"))
        seen = scan(spans, lambda x: F.when(is_rule(x), x["end"]).otherwise(0), F.greatest, F.lit(0), told)
        return F.when(F.size(spans) > 0, F.transform(F.filter(seen, lambda x: x["stays"]), lambda x: x["span"])).otherwise(spans)

    return docs.withColumn(out, let(F.array_sort(F.concat(base, dense)), uncovered).cast(_SPAN))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", **settings) -> DataFrame:
    """docs with every span of find_secrets replaced by mark, spans that overlap by one mark. Null text stays null."""
    spans_col = free_name(docs, "secret_spans")
    text, spans = F.col(f"`{text_col}`").cast("string"), F.col(spans_col)

    def part(x: Column, reach: Column) -> Column:
        """What stands between the spans before and this one, with the mark; nothing if they overlap."""
        joins = (x["start"] < reach) & (reach > 0)
        return F.when(joins, "").otherwise(F.concat(F.substring(text, reach + 1, x["start"] - reach), F.lit(mark)))

    parts = scan(spans, lambda x: x["end"], F.greatest, F.lit(0), part)
    end = F.array_max(F.transform(spans, lambda x: x["end"]))
    clean = F.concat(F.array_join(parts, ""), F.substring(text, end + 1, F.length(text)))
    found = find_secrets(docs, text_col, out=spans_col, **settings)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).drop(spans_col)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """A row per input row: id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    found = find_secrets(docs.select(id_col, F.col(f"`{text_col}`").alias("text__")), "text__", out="spans__", **settings).select(id_col, "spans__")
    spans = F.col("spans__")
    number = lambda *kinds: F.size(F.filter(spans, lambda x: x["kind"].isin([KINDS.index(k) for k in kinds]))).cast("long")
    return found.select(
        id_col,
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        number("entropy_hex", "entropy_base64").alias("n_entropy"),
        F.sha2(written(F.filter(spans, lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        written(spans).alias("spans"),
    )
