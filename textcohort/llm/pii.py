"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame operations only.

1. **Seeds.**  Four base patterns (email, ip, card, phone) with their checks give spans in code points.
2. **Mentions.**  A base span, whole, is a seed instance of its kind.  Elsewhere a mention is a run of words
   with a digit or an at sign, joined by single blanks (``555 010 1234``), or words joined by ``[at]`` or
   ``(at)`` with or without blanks.  As a run may hold more than the identifier, every window of its words
   that starts or ends within ``reach`` words of the run's context is a candidate, of at most ``RUN_DIGITS``
   digits where it has several words; a pattern counts a run once, by its longest candidate.  The words
   beside a mention induce lexical patterns: the ``context`` words before, fewer of them, those after, and
   the words on both sides.  Seeds induce layouts too (the lengths of their groups of digits, a phone's also
   without its country code; without a plus, a number of as many digits before may be one).  A window that has other numbers on both sides counts only with a layout that
   ``least_seeds`` seeds have.
3. **Graph.**  Patterns and instances (by value) are the two sides of a graph.  In each round a pattern's
   confidence for a kind is the score of its instances over their number (plus one), and an
   unseen instance's score is the noisy-or of its patterns' confidences.  Only patterns of at least
   ``least_seeds`` seed instances and confidence ``floor`` pass scores on; an instance that the round before
   accepts counts as a seed with its score, so each round can use a further generation of patterns.
4. **Discovery.**  Unseen instances whose score reaches ``accept`` after the last round, and with a form
   that their kind can have, become additional spans.  Where accepted windows of a run overlap, one with a
   layout of its kind is taken first (the longest) and explains the context on its side; else the whole run, else the
   shortest window: numbers beside an identifier are no part of it.  Base spans stay as they are.

Base patterns are written so that a search is linear in the text: a run is entered at its start
only (or where the last match ended, ``\\G``), and groups are possessive, which changes no match because
what follows a group never begins with a character of the group.

Positions are prefix sums within the row, so no text is exploded; only mentions, a small part of the
words, become rows.  A frequent pattern is a key only after partial aggregation, or of narrow rows that
AQE's skew join splits.

Results for odd inputs: a null or empty text has no span; texts are read whole; rows that repeat a
doc_id are told apart by the hash of their text, and equal rows get equal spans; equal identifiers count
once as instances; an empty table gives an empty result; a null id is passed on.  Only the id and text
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcohort.llm.common import doc_texts, materialize

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"[\[(]at[\])]"
_SPELLED = rf"\S+\x20?{_AT}\x20?\S+"
_MARKED = r"[^\s0-9@]*+[0-9@]\S*+"
MENTION = rf"(?<!\S)(?:{_SPELLED}|{_MARKED}(?:\x20(?!{_SPELLED}){_MARKED})*+)"
#: Several words are one candidate if they have at most so many digits (the most that a kind has) and words.
RUN_DIGITS = 19
_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
#: Rounds of scoring, the confidence from which a pattern passes scores on, the score that accepts, the
#: seed instances that a pattern needs at least.
ROUNDS, FLOOR, ACCEPT, LEAST_SEEDS = 3, 0.6, 0.8, 4
#: Words on a side that make a pattern, and words of a run between its context and a window that it may support.
CONTEXT, REACH = 2, 8
#: Code points of a gap that are enough in nearly all cases to see those words; else the gap is taken whole.
_NEAR = 64
_BLOCK = 128


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every second digit is doubled."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, r"[^0-9]", "")
    n = F.length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), _luhn(digits)).otherwise(False)


def _before(lens: Column, sums: Column, i: Column) -> Column:
    """Sum of the first ``i`` numbers of ``lens``, with the sums of its blocks of ``_BLOCK``."""
    block = (i / _BLOCK).cast("int")
    add = lambda a, x: a + x
    return F.aggregate(F.slice(sums, 1, block), F.lit(0), add) + F.aggregate(F.slice(lens, block * _BLOCK + 1, i - block * _BLOCK), F.lit(0), add)


def _beside(gap: Column, left: bool, context: int) -> Column:
    """The end of a gap beside a match with at least ``context`` whole words, and without a part of a word;
    the whole gap, where a short end does not show as many."""
    end = F.right(gap, F.lit(_NEAR)) if left else F.left(gap, F.lit(_NEAR))
    # a word that the cut may have gone through is dropped, with all that touches it
    end = F.regexp_replace(end, r"^\S++" if left else r"(?<!\S)\S++$", "")
    # a search makes no list of words
    shown = end.rlike(rf"(?:[\p{{L}}']++[^\p{{L}}']++){{{context}}}[\p{{L}}']")
    return F.when((F.char_length(gap) <= _NEAR) | ~shown, gap).otherwise(end)


def _matched(df: DataFrame, name: str, pattern: str, where: Column, context: int = CONTEXT) -> DataFrame:
    """Add ``name``: an array of ``(text, start, end, left, right)`` of the matches, with the ends of the
    gaps beside each one.  A pattern is searched only where the cheap test ``where`` holds."""
    none = F.array().cast("array<string>")
    m, g, lens, sums = (f"_{name}_{x}" for x in "mgls")
    df = df.withColumn(m, F.when(where, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split("text", pattern, -1)).otherwise(none))
    df = df.withColumn(lens, F.zip_with(m, g, lambda x, gap: F.coalesce(F.char_length(x), F.lit(0)) + F.coalesce(F.char_length(gap), F.lit(0))))
    last = F.greatest(F.size(lens) - 1, F.lit(0))
    df = df.withColumn(sums, F.transform(F.sequence(F.lit(0), (last / _BLOCK).cast("int")),
                                         lambda b: F.aggregate(F.slice(lens, b * _BLOCK + 1, _BLOCK), F.lit(0), lambda a, x: a + x)))

    def span(x: Column, i: Column) -> Column:
        end = _before(F.col(lens), F.col(sums), i + 1)
        return F.struct(x.alias("text"), (end - F.char_length(x)).alias("start"), end.alias("end"),
                        _beside(F.get(g, i), True, context).alias("left"), _beside(F.get(g, i + 1), False, context).alias("right"))

    return df.withColumn(name, F.transform(m, span)).drop(m, g, lens, sums)


def _only_valid(kind: str, matches: Column) -> Column:
    valid = F.filter(matches, lambda x: _valid(kind, x["text"]))
    return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"),
                                                 x["left"].alias("left"), x["right"].alias("right")))


def base_spans(df: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Add ``email``, ``ip``, ``card``, ``phone``: arrays of ``(start, end, text, left, right)`` of the valid base
    matches."""
    digit = F.col("text").rlike("[0-9]")
    tests = {"email": F.contains("text", F.lit("@")), "ip": digit & F.contains("text", F.lit(".")), "card": digit, "phone": F.contains("text", F.lit("+"))}
    for kind in KINDS:
        df = _matched(df, f"all_{kind}", BASE[kind], tests[kind], context)
        df = df.withColumn(kind, _only_valid(kind, F.col(f"all_{kind}"))).drop(f"all_{kind}")
    return df


def _overlaps(spans: Column, mention: Column) -> Column:
    """Whether one of the spans, which are apart and ascending, overlaps a mention: only the last one that
    starts before the mention's end can."""
    n = F.size(spans)
    steps = F.filter(F.array(*[F.lit(1 << b) for b in range(30, -1, -1)]), lambda s: s <= n)
    at = F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= n) & (F.get(spans, a + s - 1)["start"] < mention["end"]), a + s).otherwise(a))
    return (n > 0) & (at > 0) & (F.get(spans, at - 1)["end"] > mention["start"])


def _overlaps_any(spans: list[str], mention: Column) -> Column:
    found = F.lit(False)
    for name in spans:
        found = found | _overlaps(F.col(name), mention)
    return found


def _words(gap: Column) -> Column:
    return F.filter(F.split(F.lower(gap), r"[^\p{L}']+"), lambda w: w != "")


def _patterns(left: Column, right: Column, context: int = CONTEXT) -> Column:
    """The lexical patterns of a mention from the words beside it: one to ``context`` words before, two (one, if
    ``context`` is) to ``context`` after, and one on each side.  A gap's words touch the mention, so a gap without a word gives no
    pattern on its side."""
    before, after = _words(left), _words(right)
    b = [F.get(before, F.size(before) - n) for n in range(1, context + 1)]
    a = [F.get(after, F.lit(n)) for n in range(context)]

    def joined(mark: str, words: list[Column]) -> Column:
        return F.concat(F.lit(mark), *[x for w in words for x in (F.lit(" "), w)])

    made = [joined("<", b[:n][::-1]) for n in range(context, 0, -1)] + [joined(">", a[:n]) for n in range(min(2, context), context + 1)]
    made.append(F.concat(F.lit("= "), b[0], F.lit(" _ "), a[0]))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def _can_be(kind: Column, value: Column) -> Column:
    """Whether a mention has a form that an identifier of the kind can have."""
    digits = F.length(F.regexp_replace(value, r"[^0-9]", ""))
    return (F.when(kind == 0, value.rlike(r"(?:@|[\[(]at[\])]).*\p{L}")).when(kind == 1, (digits >= 3) & value.rlike(r"[.:].*[.:]"))
            .when(kind == 2, digits >= 12).otherwise(digits.between(6, 15)))


def layout(value: Column) -> Column:
    """The form of an identifier: an at sign, four dotted numbers, or the lengths of its groups of digits."""
    groups = F.transform(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda g: F.char_length(g).cast("string"))
    return (F.when(value.rlike(rf"@|{_AT}"), "@").when(value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "....")
            .otherwise(F.array_join(groups, "-")))


def seed_layouts(mentions: DataFrame, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """``(known, layout)``: the layouts that at least ``least_seeds`` seed instances of a kind have.  A phone's country
    code (a group of one to three digits after the plus) can be missing."""
    form = layout(F.col("value"))
    without = F.when((F.col("kind") == KINDS.index("phone")) & F.col("value").startswith("+"), F.regexp_extract(form, "^[123]-(.+)$", 1)).otherwise("")
    forms = mentions.filter("kind IS NOT NULL").select("value", F.col("kind").alias("known"), F.explode(F.array(form, without)).alias("layout"))
    return (forms.filter("layout <> ''").distinct().groupBy("known", "layout").count()
            .filter(F.col("count") >= least_seeds).drop("count"))


def _graph(mentions: DataFrame) -> DataFrame:
    """Distinct edges ``(pattern, value, kind, main)``: a value's kind is null where it is unseen; ``main`` ones
    count in the pattern's confidence."""
    return (mentions.select("value", "kind", "main", F.explode("patterns").alias("pattern"))
            .groupBy("pattern", "value").agg(F.min("kind").alias("kind"), F.max("main").alias("main")))


def discovered(mentions: DataFrame, rounds: int = ROUNDS, floor: float = FLOOR, accept: float = ACCEPT, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """``(value, kind)`` of the unseen instances that confident patterns find."""
    graph = materialize(_graph(mentions), "pattern-graph")
    edges = graph.filter("main")
    names = [f"s{k}" for k in range(len(KINDS))]
    seed = [F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in range(len(KINDS))]
    unseen = graph.filter(F.col("kind").isNull()).select("pattern", "value")
    scored = edges.select("pattern", "value", "kind", *[s.alias(n) for s, n in zip(seed, names, strict=True)])
    best = F.greatest(*names)
    kind = F.coalesce(*[F.when(F.col(n) == best, F.lit(k)) for k, n in enumerate(names)])
    accepted = F.when((best >= accept) & _can_be(kind, F.col("value")), kind)
    scored = scored.withColumn("seed", F.col("kind"))
    found = None
    for _ in range(rounds):
        if found is not None:
            known = found.select("value", *[F.col(n).alias(f"u{n}") for n in names], accepted.alias("accepted"))
            scored = edges.join(known, "value", "left").select("pattern", "value", F.coalesce("kind", "accepted").alias("seed"), *[
                F.when(F.col("kind").isNull(), F.coalesce(f"u{n}", F.lit(0.0))).otherwise(s).alias(n) for s, n in zip(seed, names, strict=True)])
        confidence = scored.groupBy("pattern").agg(*[(F.sum(n) / (F.count(F.lit(1)) + 1)).alias(n) for n in names],
                                                   *[F.sum(F.when(F.col("seed") == k, F.col(n)).otherwise(0.0)).alias(f"n{k}") for k, n in enumerate(names)])
        sure = confidence.filter(" OR ".join(f"({n} >= {floor} AND n{k} >= {least_seeds})" for k, n in enumerate(names)))
        miss = [F.when((F.col(n) >= floor) & (F.col(f"n{k}") >= least_seeds), F.log(1 - F.least(n, F.lit(0.999)))).otherwise(0.0) for k, n in enumerate(names)]
        # only the sure patterns meet the unseen instances
        found = unseen.join(sure.select("pattern", *[m.alias(n) for m, n in zip(miss, names, strict=True)]), "pattern").groupBy("value").agg(
            *[(1 - F.exp(F.sum(n))).alias(n) for n in names])
    return found.select("value", accepted.alias("kind")).filter("kind IS NOT NULL")


def _seeds(context: int) -> Column:
    """The base spans as seed instances, each where no span of an earlier kind overlaps it.  Their context is
    that of the words they stand in: from white space on, up to the next word with a digit or at sign."""
    def seed(number: int, x: Column) -> Column:
        # entered at the start of a word only, so that each search is linear
        left = F.regexp_replace(F.regexp_replace(x["left"], r"(?<!\S)\S++$", ""), rf"(?s)^.*(?:[0-9@]|{_AT})\S*", "")
        right = F.regexp_replace(F.regexp_replace(x["right"], r"^\S+", ""), rf"(?s)(?<!\S)\S*?(?:[0-9@]|{_AT}).*$", "")
        return F.struct(F.lower(x["text"]).alias("value"), x["start"].alias("start"), x["end"].alias("end"), F.lit(number).alias("kind"),
                        _patterns(left, right, context).alias("patterns"), F.lit(True).alias("main"), F.lit("=").alias("side"), x["start"].alias("run"))

    kinds = []
    for number, kind in enumerate(KINDS):
        apart = F.filter(F.col(kind), lambda x: ~_overlaps_any(list(KINDS[:number]), x)) if number else F.col(kind)
        kinds.append(F.transform(apart, lambda x: seed(number, x)))
    return F.concat(*kinds)


def _candidates(run: Column, context: int, reach: int) -> Column:
    """The candidates ``(text, start, end, patterns, side)`` of a run: the windows of its words that start within
    ``reach`` words of its start or end within as many of its end.  ``side`` is ``=`` for the whole run, ``<`` or ``>`` for a
    window at its start or end, which has the patterns of that side, and empty for one between other words."""
    most, near = F.lit(RUN_DIGITS), F.lit(reach)

    def possible(text: Column, words: Column, touching: Column) -> Column:
        digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
        form = digits.between(6, RUN_DIGITS) | text.rlike(r"@|[\[(]at[\])]|[.:].*[.:]")
        return (F.size(words) == 1) & (touching | form) | (F.size(words) > 1) & (digits <= RUN_DIGITS) & (touching | form)

    def made(r: Column, i: Column, size: Column) -> Column:
        words, n = r["words"], F.size(r["words"])
        before, text = F.slice(words, F.lit(1), i), F.array_join(F.slice(words, i + 1, size), " ")
        after = F.slice(words, i + size + 1, n - i - size)
        # a window is near one end of the run; its place is counted from there
        ahead = r["start"] + F.char_length(F.array_join(before, " ")) + F.when(i > 0, 1).otherwise(0)
        behind = r["end"] - F.char_length(F.array_join(after, " ")) - F.when(n - i - size > 0, 1).otherwise(0) - F.char_length(text)
        start = F.when(i <= near, ahead).otherwise(behind)
        first, last = i == 0, i + size == n
        side = F.when(first & last, "=").when(first, "<").when(last, ">").otherwise("")

        def holds(p: Column) -> Column:
            mark = F.substring(p, 1, 1)
            inner = (mark == "<") & (i <= near) | (mark == ">") & (n - i - size <= near)
            return F.when(side == "=", True).when(side == "", inner).otherwise(mark == side)

        c = F.struct(text.alias("text"), start.alias("start"), (start + F.char_length(text)).alias("end"), F.filter(r["patterns"], holds).alias("patterns"),
                     side.alias("side"))
        return F.when(possible(text, F.slice(words, i + 1, size), side != ""), c)

    def of(r: Column) -> Column:
        n = F.size(r["words"])
        ends = F.sequence(F.lit(0), F.least(near, n - 1))
        first = F.transform(ends, lambda i: F.transform(F.sequence(F.lit(1), F.least(most, n - i)), lambda size: made(r, i, size)))
        last = F.transform(ends, lambda e: F.transform(F.filter(F.sequence(F.lit(1), F.least(most, n - e)), lambda size: n - e - size > near),
                                                       lambda size: made(r, n - e - size, size)))
        several = F.filter(F.concat(F.flatten(first), F.flatten(last)), lambda c: c.isNotNull())
        alone = F.struct(run["text"].alias("text"), r["start"].alias("start"), r["end"].alias("end"), r["patterns"].alias("patterns"), F.lit("=").alias("side"))
        return F.when(n == 1, F.array(alone)).otherwise(several)

    words = F.when(run["text"].rlike(rf"^{_SPELLED}$"), F.array(run["text"])).otherwise(F.split(run["text"], " "))
    bound = F.array(F.struct(words.alias("words"), run["start"].alias("start"), run["end"].alias("end"),
                             _patterns(run["left"], run["right"], context).alias("patterns")))
    return F.flatten(F.transform(bound, of))


def _unseen(run: Column, context: int, reach: int) -> Column:
    """The candidates of a run that no base span overlaps, trimmed; the longest at each side is ``main``."""
    free = F.filter(_candidates(run, context, reach), lambda c: ~_overlaps_any(list(KINDS), c))

    def of(all_: Column) -> Column:
        def main(c: Column) -> Column:
            longer = F.exists(all_, lambda b: (b["side"] != "") & (b["start"] <= c["start"]) & (b["end"] >= c["end"])
                              & (b["end"] - b["start"] > c["end"] - c["start"]))
            return F.when(c["side"] == "", False).otherwise(~longer)

        return F.transform(all_, lambda c: _trim(c, main(c), run["start"]))

    return F.flatten(F.transform(F.array(free), of))


def _trim(mention: Column, main: Column, run: Column) -> Column:
    """A mention without the punctuation around it (a parenthesis about its first digits is kept)."""
    outer = r"^(?:(?!\([0-9]++\).*[\p{L}\p{N}])[^\p{L}\p{N}+@])*+"
    lead = F.char_length(F.regexp_extract(mention["text"], outer, 0))
    core = F.regexp_replace(F.regexp_replace(mention["text"], outer, ""), r"[^\p{L}\p{N}]++$", "")
    return F.struct(F.lower(core).alias("value"), (mention["start"] + lead).alias("start"), (mention["start"] + lead + F.char_length(core)).alias("end"),
                    F.lit(None).cast("int").alias("kind"), mention["patterns"].alias("patterns"), main.alias("main"), mention["side"].alias("side"), run.alias("run"))


def _numbered(kind: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _apart(found: Column) -> Column:
    """The accepted windows ``(known, side, kind, start, end)`` of one run that become spans: none overlaps one
    that comes before it in rank, and one without a known layout goes where a window with one explains its context."""
    def ranked(s: Column) -> Column:
        size = s["end"] - s["start"]
        order = F.when(s["known"], -size).when(s["side"] == "=", 0).otherwise(size)
        return F.struct((~s["known"]).alias("r"), order.alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))

    def take(taken: Column, s: Column) -> Column:
        clash = F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))))

    def explained(s: Column) -> Column:
        return F.exists(found, lambda t: t["known"] & (t["side"].isin("", "=") | (t["side"] == s["side"])))

    able = F.filter(found, lambda s: s["known"] | ~explained(s))
    return F.aggregate(F.sort_array(F.transform(able, ranked)), F.array().cast("array<struct<kind:int,start:int,end:int>>"), take)


def count_of(kind: int, spans: Column) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, floor: float = FLOOR, accept: float = ACCEPT,
                  least_seeds: int = LEAST_SEEDS, context: int = CONTEXT, reach: int = REACH) -> DataFrame:
    """``doc_id, text_hash, base, spans``: arrays of ``(kind, start, end)`` with the kind as its number in
    ``KINDS``, by kind and start; ``spans`` holds the base spans and the discovered ones."""
    df = doc_texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    df = _matched(base_spans(df, context), "mention", MENTION, F.col("text").rlike(r"[0-9@]|[\[(]at[\])]"), context)
    base = F.concat(*[_numbered(n, F.col(k)) for n, k in enumerate(KINDS)])
    mentions = F.concat(_seeds(context), F.flatten(F.transform("mention", lambda run: _unseen(run, context, reach))))
    # from here on no text: what each row found, written once
    found = materialize(df.select("doc_id", "text_hash", base.alias("base"), mentions.alias("mentions")), "mentions")
    rows = found.filter(F.size("mentions") > 0).select("doc_id", "text_hash", F.inline("mentions")).filter("value <> ''")
    layouts = materialize(seed_layouts(rows, least_seeds), "layouts")
    # windows between other numbers count only with a layout of the seeds
    inner = rows.filter("side = ''").withColumn("layout", layout(F.col("value"))).join(layouts, "layout", "left_semi").select(rows.columns)
    rows = rows.filter("side <> ''").unionByName(inner)
    new = discovered(rows.select("value", "kind", "patterns", "main"), rounds, floor, accept, least_seeds)
    key = [F.coalesce("doc_id", F.lit(-(2 ** 63))).alias("id"), "text_hash"]
    window = F.struct("known", "side", "kind", "start", "end")
    shapes = layouts.select(F.col("known").alias("kind"), "layout", F.lit(True).alias("known"))
    # a run has a bounded number of candidates; those beside others that are taken go
    added = (rows.filter(F.col("kind").isNull()).select("doc_id", "text_hash", "run", "value", "start", "end", "side").join(new, "value")
             .withColumn("layout", layout(F.col("value"))).join(shapes, ["kind", "layout"], "left")
             .withColumn("known", F.coalesce("known", F.lit(False))).filter("known OR side <> ''")
             .groupBy(*key, "run").agg(F.collect_set(window).alias("all"))
             .groupBy("id", "text_hash").agg(F.flatten(F.collect_list(_apart(F.col("all")))).alias("added")))
    joined = found.withColumn("id", F.coalesce("doc_id", F.lit(-(2 ** 63)))).join(added, ["id", "text_hash"], "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return joined.select("doc_id", "text_hash", "base", F.sort_array(F.concat("base", F.coalesce("added", none))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; a span that begins within an earlier one
    is covered by that one's replacement."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

    def put(state: Column, s: Column) -> Column:
        end = F.greatest(state["at"], -s["end"])
        gap = F.when(s["start"] >= state["at"], F.concat(F.substr(text, state["at"] + 1, s["start"] - state["at"]), F.get(names, s["kind"]))).otherwise("")
        return F.struct(end.alias("at"), F.concat(state["out"], gap).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(ordered, start, put, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their personal data replaced, ``n_chars`` being the new length.  Texts without a
    span are returned as they are (a null text stays null)."""
    lowest = F.lit(-(2 ** 63))
    spans = (personal_data(docs).filter(F.size("spans") > 0)
             .select(F.coalesce("doc_id", lowest).alias("_id"), F.col("text_hash").alias("_th"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_th"]))
    # the row travels as one struct, whatever its columns are called
    named = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), lowest).alias("_id"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    joined = named.join(spans, ["_id", "_th"], "left")
    untouched = F.col("_spans").isNull()
    row = F.col("_row").withField("text", F.when(untouched, F.col("_row.text")).otherwise(redacted(F.col("_row.text"), F.col("_spans"))))
    out = joined.withColumn("_row", row)
    if "n_chars" in docs.columns:
        out = out.withColumn("_row", F.col("_row").withField("n_chars", F.when(untouched, F.col("_row.n_chars")).otherwise(F.char_length("_row.text").cast("long"))))
    return out.select("_row.*")
