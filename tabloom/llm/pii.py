"""Personal data by bootstrapped contextual extraction, in SQL functions only.

1. Base recognisers give seed spans (e-mail, IP address, card, phone), exactly.
2. Base spans are cut out.  Candidates are the spans themselves, each remaining word that
   holds a digit or an at sign, and runs of such words that together have the shape of a
   phone or card and hold none that is long enough alone.  The two words before one, the
   words on either side of it, and each of these alone are its lexical patterns; a base
   span or a number among them counts as a word, the same for all of a kind.  Long words of
   lower-case hexadecimal digits are the seeds of a fifth kind, ``secret``.  They are no
   base spans: like any other candidate they are marked only where a pattern says so.
3. The graph of patterns and candidate strings is scored in rounds: a pattern by the
   share of its strings that are known identifiers of a kind, a string by the patterns
   it stands in.
4. Patterns of high confidence and support mark further candidates of a fitting shape.  A
   single word needs more support, as there are few strings in most of a word's places.
   They are looked up with spans and numbers as words and without.  Of candidates that
   overlap the surest stays, then that of the most usual number of digits.

Base spans always stay.  Positions are code points, ends exclusive.  All passes after
the first read a checkpoint that holds spans and candidates, not the texts.

Defined results: a null or empty text has no spans.  Repeated rows get the same spans.
Rows are told apart by id and text hash, so null ids are allowed.  Other columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.sizing import cut_lineage
from tabloom.llm.matches import in_blocks, literal, matches, piece, running
from tabloom.llm.places import by_place

# The kinds and what the base recognisers accept.  Possessive repeats and
# the guards at the start keep long runs linear without changing what is found.
KINDS = ("email", "ip", "card", "phone")
# A kind without base recogniser, whose spans all come from patterns.
ALL_KINDS = (*KINDS, "secret")
# What a redacted span is replaced by; those of the base kinds stand for contact data.
ALL_MARKS = tuple(f"[{k.upper()}]" for k in ALL_KINDS)
MARKS = ALL_MARKS[: len(KINDS)]
# What seeds the fifth kind, and what it may look like (in lower case).
SECRET_SEED = "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$"
SECRET_SHAPE = "^(?=.*[0-9])(?=.*[a-z])[0-9a-z_+/=-]{16,}$"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A word from its first digit or at sign, and the blank after it; what it has before is added
# afterwards.
WORD = r"[0-9@][^\x20\x09-\x0D]*+\x20?+"
# Words of a run that are tried as one identifier, and the digits a word has that is one alone.
RUN_WORDS = 19
WHOLE_DIGITS = 9
# Digits that identifiers of a kind usually have.
USUAL_DIGITS = {"card": 16, "phone": 10}
# Pieces are taken from blocks of so many code points, as finding a place in a long text is slow.
BLOCK = 1024
# Where a base span is cut out it leaves a mark: a private-use sign for its kind.
_CUT = [chr(0xE000 + n) for n in range(len(KINDS))]
# What numbers in a context are read as.
_NUMBER = chr(0xE000 + len(KINDS))
# Code points on either side in which context words are looked for.
CONTEXT = 96
# Rounds over the graph; confidence and distinct known strings a pattern must reach.
ROUNDS = 3
CONFIDENCE = 0.85
SUPPORT = 5
# As many times the support a pattern of a single word must have.
SINGLE_WORD = 4

_IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _valid(kind: str, m: str) -> str:
    """SQL condition on a match string ``m``."""
    if kind == "ip":
        return f"{m} rlike {literal(f'^{_IP_PART}(?:[.]{_IP_PART}){{3}}$')}"
    if kind == "phone":
        return f"length({_digits(m)}) between 9 and 15"
    if kind == "card":
        d = _digits(m)
        digit = f"int(substr({d}, i, 1))"
        value = (
            f"if((length({d}) - i) % 2 = 1, {digit} * 2 - if({digit} > 4, 9, 0), {digit})"
        )
        total = f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + {value})"
        return f"if(length({d}) between 13 and 19, {total} % 10 = 0, false)"
    return "true"


def _joined(spans: str) -> Column:
    """``kind:start:end`` of an array of ``(kind, start, end)``, kinds in their order."""
    names = f"array({', '.join(repr(k) for k in ALL_KINDS)})"
    return F.expr(
        f"array_join(transform(array_sort({spans}), s -> concat(element_at({names}, s.kind + 1), ':', s.start, ':', s.end)), ',')"
    )


def _shape_fits(kind: str, x: str) -> str:
    digits = f"length({_digits(x)})"
    return {
        "email": f"{x} rlike '^[^@]+@[^@]+[.][^@]+$'",
        "ip": f"{x} rlike '^[0-9A-Fa-f]*(?:[:.][0-9A-Fa-f]*){{3,}}$'",
        "card": f"({digits} between 12 and 19 and {x} rlike '^[0-9 ./-]+$')",
        "phone": f"({digits} between 7 and 15 and {x} rlike '^[0-9 ()./+-]+$')",
        "secret": f"{x} rlike '{SECRET_SHAPE}'",
    }[kind]


def _far(x: str) -> str:
    """How far the digits of ``x`` are from the usual number; a one before ten is a country's."""
    digits = _digits(x)
    return (
        f"case kind when {KINDS.index('card')} then abs(length({digits}) - {USUAL_DIGITS['card']})"
        f" when {KINDS.index('phone')} then if({digits} like '1__________', 0, abs(length({digits}) - {USUAL_DIGITS['phone']})) else 0 end"
    )


# Spans by start: one that overlaps the last kept takes its place if it is better or as good and longer.
_SPAN = "array<struct<kind:int,start:int,end:int>>"
_OPEN = "struct<start:int,end:int,best:struct<conf:double,near:int,minus:int>>"
_CLOSED = "struct(-a.at.best.minus as kind, a.at.start as start, a.at.end as end)"
_SWEEP = running(
    "more",
    f"cast(null as {_OPEN})",
    _SPAN,
    "struct(if(a.at is null or s.start >= a.at.end or"
    " (s.best.conf, s.best.near, s.end - s.start) > (a.at.best.conf, a.at.best.near, a.at.end - a.at.start), s, a.at) as at,"
    f" if(a.at is null or s.start < a.at.end, a.out, concat(a.out, array({_CLOSED}))) as out)",
    f"if(a.at is null, a.out, concat(a.out, array({_CLOSED})))",
)


def _replaced(blocks: str, length: str, spans: str, by: str, gap: str) -> str:
    """SQL of a text, given in blocks, with its spans replaced by ``by``, of overlapping ones the first.

    ``gap`` stands for the code points of a later one beyond those before it.
    """
    by_start = f"array_sort(transform({spans}, s -> struct(s.start as start, s.kind as kind, s.end as end)))"
    return running(
        by_start,
        "0",
        "array<string>",
        f"struct(greatest(a.at, s.end) as at, concat(a.out, if(s.start >= a.at, array({piece(blocks, 'a.at', 's.start - a.at', BLOCK)}, {by}),"
        f" array({gap}))) as out)",
        f"concat(array_join(a.out, ''), {piece(blocks, 'a.at', f'{length} - a.at', BLOCK)})",
    )


def base_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, key, base, candidates``: one pass over the texts."""
    df = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("txt")
    ).withColumn("key", F.xxhash64("txt"))
    parts = []
    for number, kind in enumerate(KINDS):
        needs = {"email": "@", "phone": "+", "ip": "."}.get(kind)
        df = matches(df, "txt", f"m_{kind}", PATTERNS[kind], needs)
        parts.append(
            f"transform(filter(m_{kind}, s -> {_valid(kind, 's.found')}),"
            f" s -> struct({number} as kind, s.start as start, s.end as end, s.found as found))"
        )
    df = df.withColumn("seeds", F.expr(f"concat({', '.join(parts)})"))
    df = df.withColumn("base", F.expr("transform(seeds, s -> struct(s.kind as kind, s.start as start, s.end as end))"))
    # The text with base spans cut out: line breaks that end every run, and the kind's mark.
    marks = f"array({', '.join(repr(c) for c in _CUT)})"
    mark = f"concat('\\n', element_at({marks}, s.kind + 1), repeat('\\n', s.end - s.start - 2))"
    df = df.withColumn("blocks", F.expr(f"if(size(base) = 0, null, {in_blocks('txt', BLOCK)})"))
    cut = _replaced("blocks", "length(txt)", "base", mark, "repeat('\\n', greatest(s.end - a.at, 0))")
    df = df.withColumn("cut", F.expr(f"if(size(base) = 0, txt, {cut})"))
    df = matches(df, "cut", "spots", WORD, None)
    df = df.withColumn("blocks", F.expr(in_blocks("cut", BLOCK)))
    before = piece("blocks", f"greatest(s.start - {CONTEXT}, 0)", f"least(s.start, {CONTEXT})", BLOCK)
    df = df.withColumn(
        "spots",
        F.expr(
            "transform(transform(transform(spots, s -> struct(s.start as start, rtrim(s.found) as found, s.found rlike '[0-9()./+-] $' as blank,"
            f" regexp_extract({before}, '[^\\\\x20\\\\x09-\\\\x0D]*$', 0) as head)),"
            " s -> struct(s.start - length(s.head) as start, concat(s.head, s.found) as found, s.blank as blank)),"
            f" s -> struct(s.start as start, s.start + length(s.found) as end, s.found as found, s.blank as blank,"
            f" length({_digits('s.found')}) as digits, s.found rlike '^[^0-9A-Za-z@]*[0-9()./+-]+[^0-9A-Za-z@]*$' and length({_digits('s.found')}) < {WHOLE_DIGITS} as part))"
        ),
    )
    # Runs of several words: parts with one blank between them, not more digits than a card has.
    words = f"transform(sequence(i, least(i + {RUN_WORDS}, size(spots)) - 1), k -> get(spots, k))"
    grown = (
        f"aggregate({words}, struct(true as go, 0 as digits, 0 as end, cast(array() as array<struct<start:int,end:int,found:string>>) as runs,"
        " '' as found), (a, w) -> if(a.go and w.part and (a.found = '' or w.start = a.end + 1) and a.digits + w.digits <= 19,"
        " struct(w.blank as go, a.digits + w.digits as digits, w.end as end,"
        " if(a.found = '' or a.digits + w.digits < 7, a.runs, concat(array(struct(s.start as start, w.end as end,"
        " concat(a.found, ' ', w.found) as found)), a.runs)) as runs,"
        " if(a.found = '', w.found, concat(a.found, ' ', w.found)) as found),"
        " struct(false as go, a.digits as digits, a.end as end, a.runs as runs, a.found as found)), a -> a.runs)"
    )
    single = "array(struct(s.start as start, s.end as end, s.found as found))"
    # Only the longest that starts at a word tells something of its patterns.
    pieces = (
        f"flatten(transform(spots, (s, i) -> transform(if(s.part and s.blank, concat({grown}, {single}), {single}),"
        " (x, j) -> struct(x.start as start, x.end as end, x.found as found, j = 0 as tells))))"
    )
    # The candidate without the punctuation around it.
    lead = "length(regexp_extract(s.found, '^[^0-9A-Za-z+(]*', 0))"
    tail = "length(regexp_extract(s.found, '[^0-9A-Za-z)]*$', 0))"
    clean = (
        f"transform({pieces}, s -> struct(s.start + {lead} as start, s.end - {tail} as end,"
        f" substr(s.found, {lead} + 1, length(s.found) - {lead} - {tail}) as found, -1 as kind, s.tells as tells))"
    )
    several = " or ".join(_shape_fits(k, "s.found") for k in ("phone", "card"))
    own = f"filter({clean}, s -> s.end > s.start and (s.found not like '% %' or {several}))"
    seeds = "transform(seeds, s -> struct(s.start as start, s.end as end, s.found as found, s.kind as kind, true as tells))"
    df = df.withColumn("own", F.expr(f"concat({seeds}, {own})"))
    around = (
        f"transform(own, s -> struct(s.start as start, s.end as end, s.found as found, s.kind as kind, s.tells as tells, {before} as left,"
        f" {piece('blocks', 's.end', str(CONTEXT), BLOCK)} as right))"
    )
    known = ", ".join(f"s.kind = {n}" for n in range(len(KINDS))) + f", s.kind < 0 and s.found rlike '{SECRET_SEED}'"
    letters = {"seen": f"\\\\p{{L}}{_NUMBER}{''.join(_CUT)}", "bare": "\\\\p{L}"}
    split = ", ".join(
        f"split(trim(regexp_replace(regexp_replace(lower(s.{side}), '[0-9]+', '{_NUMBER}'), '[^{of}]+', ' ')), ' ') as {name}_{side}"
        for name, of in letters.items()
        for side in ("left", "right")
    )
    worded = f"transform({around}, s -> struct(s.start as start, s.end as end, s.found as found, s.kind as kind, s.tells as tells, {split}))"
    candidates = (
        f"transform({worded}, s -> struct(s.start as start, s.end as end,"
        f" lower(s.found) as found, array({known}) as known, if(s.tells, {_patterns('seen')}, cast(array() as array<string>)) as patterns,"
        f" if(s.kind < 0, array_distinct(concat({_patterns('seen')}, {_patterns('bare')})), cast(array() as array<string>)) as looks))"
    )
    return df.withColumn("candidates", F.expr(candidates)).select("doc_id", "key", "base", "candidates")


def _patterns(words: str) -> str:
    """SQL array of the patterns of ``s`` from the words on its sides."""
    left, right = f"s.{words}_left", f"s.{words}_right"
    two = f"concat('2|', array_join(slice({left}, greatest(size({left}) - 1, 1), 2), ' '))"
    last, first = f"element_at({left}, -1)", f"element_at({right}, 1)"
    single = f"filter(array(concat('L|', {last}), concat('R|', {first})), p -> length(p) > 2)"
    return f"concat(array({two}, concat('1|', {last}, '|', {first})), {single})"


def _strong(kind: str, confidence: float, support: int, conf: str | None = None, hits: str | None = None) -> str:
    """SQL condition on a scored pattern."""
    needs = f"if(pattern like 'L|%' or pattern like 'R|%', {support * SINGLE_WORD}, {support})"
    return f"({conf or f'conf_{kind}'} >= {confidence} and {hits or f'hits_{kind}'} >= {needs})"


def pattern_scores(
    spots: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT
) -> DataFrame:
    """``pattern`` and for each kind ``conf_<kind>`` and ``hits_<kind>``.

    ``spots`` holds one row per candidate: ``found, known, patterns``.
    """
    edges = cut_lineage(
        spots.select("found", F.explode("patterns").alias("pattern")).distinct()
    )
    fits = {k: F.expr(_shape_fits(k, "found")) for k in ALL_KINDS}
    seeds = spots.groupBy("found").agg(
        *(F.max(F.element_at("known", n + 1)).cast("double").alias(f"s_{k}") for n, k in enumerate(ALL_KINDS))
    )
    seeds = cut_lineage(seeds)
    scores = seeds
    for turn in range(rounds):
        # A string that is not known speaks against a kind, half as much if its shape fits.
        against = {k: F.when(fits[k], 0.5).otherwise(1.0) * (1 - F.col(f"s_{k}")) for k in ALL_KINDS}
        patterns = edges.join(scores, "found").groupBy("pattern").agg(
            *(F.sum(f"s_{k}").alias(f"hits_{k}") for k in ALL_KINDS),
            *(F.sum(against[k]).alias(f"wrong_{k}") for k in ALL_KINDS),
        )
        conf = {k: F.col(f"hits_{k}") / (F.col(f"hits_{k}") + F.col(f"wrong_{k}") + 0.25) for k in ALL_KINDS}
        patterns = cut_lineage(
            patterns.select(
                "pattern",
                *(f"hits_{k}" for k in ALL_KINDS),
                *(conf[k].alias(f"conf_{k}") for k in ALL_KINDS),
            )
        )
        if turn == rounds - 1:
            return patterns
        strong = patterns.filter(
            " or ".join(_strong(k, confidence, support) for k in ALL_KINDS)
        )
        # A string is an identifier unless all of its strong patterns are wrong.
        doubt = {
            k: F.when(
                F.expr(_strong(k, confidence, support)) & fits[k],
                F.log(1 - F.least(F.col(f"conf_{k}"), F.lit(0.99))),
            ).otherwise(0.0)
            for k in ALL_KINDS
        }
        reached = (
            edges.join(strong, "pattern")
            .groupBy("found")
            .agg(*((1 - F.exp(F.sum(doubt[k]))).alias(f"r_{k}") for k in ALL_KINDS))
        )
        scores = seeds.join(reached, "found", "left").select(
            "found",
            *(F.greatest(f"s_{k}", F.coalesce(f"r_{k}", F.lit(0.0))).alias(f"s_{k}") for k in ALL_KINDS),
        )
    return patterns


def spans(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rounds: int = ROUNDS,
    confidence: float = CONFIDENCE,
    support: int = SUPPORT,
) -> DataFrame:
    """``doc_id, key, base, all_spans``: a row per document, arrays of ``(kind, start, end)``.

    ``key`` is the text's hash; ``kind`` the position in ``KINDS``.
    """
    table = cut_lineage(base_table(docs, doc_id, text))
    spots = table.select("doc_id", "key", F.explode("candidates").alias("c")).select(
        "doc_id", "key", "c.*"
    )
    scored = pattern_scores(spots.select("found", "known", "patterns"), rounds, confidence, support)
    strong = scored.select(
        "pattern",
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.col(f"conf_{k}").alias("conf"),
                        F.col(f"hits_{k}").alias("hits"),
                        F.lit(n).alias("kind"),
                    )
                    for n, k in enumerate(ALL_KINDS)
                )
            )
        ).alias("x"),
    ).select("pattern", "x.*").filter(_strong("", confidence, support, "conf", "hits"))
    # Base spans need no looking up.
    unseen = spots.filter(f"not exists(slice(known, 1, {len(KINDS)}), k -> k)").select(
        "doc_id", "key", "start", "end", "found", F.explode("looks").alias("pattern")
    )
    fits = F.expr("case kind " + " ".join(f"when {n} then {_shape_fits(k, 'found')}" for n, k in enumerate(ALL_KINDS)) + " end")
    found = (
        unseen.join(strong, "pattern")
        .filter(fits)
        .withColumn("far", F.expr(_far("found")))
        .groupBy("doc_id", "key", "start", "end")
        .agg(F.max(F.struct("conf", (-F.col("far")).alias("near"), (-F.col("kind")).alias("minus"))).alias("best"))
        .groupBy("doc_id", "key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "best"))).alias("more"))
        .withColumn("more", F.expr(_SWEEP))
        .select(F.col("doc_id").alias("f_id"), F.col("key").alias("f_key"), "more")
    )
    joined = table.join(
        found, table["doc_id"].eqNullSafe(found["f_id"]) & (table["key"] == found["f_key"]), "left"
    )
    none = "cast(array() as array<struct<kind:int,start:int,end:int>>)"
    return joined.select(
        "doc_id", "key", "base", F.expr(f"array_sort(concat(base, coalesce(more, {none})))").alias("all_spans")
    )


def span_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    found = spans(docs, doc_id, text, **limits)
    return found.select(
        "doc_id",
        *(
            F.expr(f"cast(size(filter(base, s -> s.kind = {n})) as bigint)").alias(f"n_{k}")
            for n, k in enumerate(KINDS)
        ),
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("all_spans").alias("spans"),
    )


def redacted(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", **limits
) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets.

    Overlapping spans of several kinds become one mark, that of the first.  ``n_chars``
    is set anew where a text changed; null texts stay null.
    """
    named = docs.columns
    docs, (doc_id, text, n_chars) = by_place(docs, doc_id, text, n_chars)
    found = spans(docs, doc_id, text, **limits).filter("size(all_spans) > 0")
    found = found.select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("all_spans").alias("__spans")
    ).groupBy("__id", "__key").agg(F.first("__spans").alias("__spans"))
    keyed = docs.withColumn("__own", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    joined = keyed.join(
        found, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left"
    )
    names = f"array({', '.join(map(repr, ALL_MARKS))})"
    new = _replaced("__blocks", f"length(`{text}`)", "__spans", f"element_at({names}, s.kind + 1)", "''")
    changed = F.col("__spans").isNotNull()
    joined = joined.withColumn("__blocks", F.when(changed, F.expr(in_blocks(f"`{text}`", BLOCK))))
    out = joined.withColumn("__new", F.when(changed, F.expr(new)).otherwise(F.col(text)))
    columns = []
    for name, kind in docs.dtypes:
        if name == text:
            columns.append(F.col("__new").alias(name))
        elif name == n_chars:
            columns.append(
                F.when(changed, F.length("__new").cast(kind)).otherwise(F.col(name)).alias(name)
            )
        else:
            columns.append(F.col(f"`{name}`"))
    return out.select(*columns).toDF(*named)
