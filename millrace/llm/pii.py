"""Personal data and secrets by bootstrapped contextual extraction.

Seeds are what four base rules find (e-mail addresses, IP addresses, card numbers
and phone numbers) and, for a fifth kind, secrets, long hexadecimal values; these
are weak seeds, which support patterns but are reported only where a trusted
pattern holds them. The words around seeds are lexical patterns: one or two words
before, the word before the last, the word after, what is glued to the value, and
before and after together. Spark scores the graph of patterns and the values that
fill them, round by round, until no pattern is new: a pattern whose distinct
values are mostly known ones of a kind, by the lower end of the usual interval of
such a share, becomes trusted, and unknown identifier-like values that trusted
patterns make sure enough become known, which supports more patterns. What is
discovered so is added to the base spans.

Candidates are tokens of five characters or more with two digits or an @ inside,
and neighbouring tokens of digits and brackets with seven digits in all.

Null and empty texts have no spans. Base spans of a kind never overlap; an added
span never overlaps a base span. Rows are keyed by doc_id and text, so repeated
rows, null doc_ids among them, each get their result.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_slices, stored, text_key

# The kinds in order and their rules; only the first four are base rules.
KINDS = ("email", "ip", "card", "phone", "secret")
_SECRET = re.compile(r"(?=[0-9]*[A-Fa-f])(?:[0-9A-Fa-f]){32,}")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN, _PART = re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: A trusted pattern holds so many distinct known values, and such a share of its values is known, by the lower end of its interval of Z deviations.
SUPPORT, CONFIDENCE, Z = 5, 0.6, 1.64
#: An unknown value is accepted if the chance that its best trusted patterns before, after and around it all err is less than one minus this.
VALUE_CONFIDENCE = 0.75
#: Rounds end when no pattern is new, at the latest after so many.
ROUNDS = 10


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping matches of ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``: each four parts of a chain of numbers and dots; long runs of digits are read once."""
    out = []
    for m in _CHAIN.finditer(text):
        if m[0].count(".") >= 3:
            parts = [p.span() for p in _PART.finditer(text, m.start(), m.end())]
            out += [(parts[i][0], parts[i + 3][1]) for i in range(0, len(parts) - 3, 4)]
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _ip(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def _card(s: str) -> bool:
    digits = _NOT_DIGIT.sub("", s)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone(s: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", s)) <= 15


def base_spans(text: str | None) -> list[list[tuple[int, int]]]:
    """Spans by kind, in the order of KINDS; offsets are code points."""
    if not text or not _DIGIT.search(text):
        return [[], [], [], []]
    return [
        emails(text),
        [(a, b) for a, b in ips(text) if _ip(text[a:b])],
        [m.span() for m in _CARD.finditer(text) if _card(m[0])],
        [m.span() for m in _PHONE.finditer(text) if _phone(m[0])] if "+" in text else [],
    ]


_SPACE, _SPACES, _NEXT = re.compile(r"\s"), re.compile(r"\s+"), re.compile(r"\s+(\S+)")
_NUMERIC = frozenset("0123456789()+-./")
#: What stands before the value in a token like key=value.
_GLUE = re.compile(r"[^=:]*[=:][\"'(\[<]*")
_EDGE = "\"'()[]<>{},;.!?:"


#: A longer word stands in a pattern by its hash.
LONG_WORD = 40


def _folded(word: str) -> str:
    word = re.sub(r"[0-9]+", "0", word.lower().strip(_EDGE))
    return word if len(word) <= LONG_WORD else xxhash.xxh3_64_hexdigest(word.encode("utf-8", "surrogatepass"))


def _before(text: str, start: int) -> tuple[str, list[str]]:
    """What is glued to a span that starts there, and the two words before."""
    size = 80
    while True:  # wide enough for whole words
        lead = text[max(0, start - size) : start]
        parts = _SPACES.split(lead)
        if size >= start or len(parts) > 4:
            break
        size *= 4
    return parts[-1], [w for w in parts[:-1] if w][-2:]


def _after(text: str, end: int) -> str:
    """The word after the token that a span ends in."""
    if m := _NEXT.search(text, end):
        return m[1]
    return ""


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: words are lowered, digits folded. The first letter tells the side: before (l), after (r) or both (b)."""
    glue, before = _before(text, start)
    glue = _folded(glue) + (glue[-1] if glue[-1] in _EDGE else "") if glue and not glue.isdigit() else ""
    before, after = [_folded(w) or w[:LONG_WORD] for w in before], _folded(_after(text, end))
    out = [f"lg {glue}"] if glue else []
    if before:
        out.append(f"l1 {before[-1]} {glue}")
    if len(before) == 2:
        out += [f"l2 {before[0]} {before[1]} {glue}", f"ls {before[0]} * {glue}"]
    if after:
        out.append(f"r1 {after}")
    if before and after:
        out.append(f"b1 {before[-1]} {glue} _ {after}")
    return out


def _tokens(text: str):
    """(start, end) of the runs of characters other than white space that hold a digit or @."""
    done = 0
    while m := _DIGIT.search(text, done):
        a = m.start()
        while a > done and not _SPACE.match(text[a - 1]):
            a -= 1
        end = _SPACE.search(text, m.end())
        done = end.start() if end else len(text)
        yield a, done


def _merged(text: str, tokens):
    """The tokens, those of digits and brackets that one blank parts being one; each with whether it was one alone."""
    held = None
    for a, b in tokens:
        if b - a <= 20 and _NUMERIC.issuperset(text[a:b]):
            if held and a == held[1] + 1 and text[held[1]] == " ":
                held = (held[0], b, False)
                continue
            if held:
                yield held
            held = (a, b, True)
            continue
        if held:
            yield held
            held = None
        yield a, b, True
    if held:
        yield held


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Identifier-like spans outside the taken ones, cut of quotes and brackets."""
    out, taken, t = [], sorted(taken), 0
    high = 0  # the furthest end of the taken spans that start before a token's end
    for a, b, alone in _merged(text, _tokens(text)):
        if alone:
            if g := _GLUE.match(text, a, b):
                a = g.end()
            while a < b and text[a] in _EDGE:
                a += 1
        while a < b and text[b - 1] in _EDGE:
            b -= 1
        while t < len(taken) and taken[t][0] < b:
            high = max(high, taken[t][1])
            t += 1
        digits = sum("0" <= c <= "9" for c in text[a:b])
        if b - a >= 5 and high <= a and (digits >= (2 if alone else 7) or "@" in text[a + 1 : b - 1]):
            out.append((a, b))
    return out


def _kind(value: str) -> int:
    """The kind of a candidate that is a weak seed; -1 for others."""
    return 4 if _SECRET.fullmatch(value) and not value.isdigit() else -1


_SPAN = "struct<kind:int,start:int,end:int>"
_BASE = f"doc_id bigint, key struct<a:bigint,b:bigint>, base array<{_SPAN}>, found array<struct<kind:int,base:boolean,start:int,end:int,value:string,patterns:array<string>>>"


def _scan(docs: DataFrame) -> DataFrame:
    """Base spans of each text, and every base span or candidate with its value and patterns; one pass."""

    def start():
        def step(ids, texts, keys):
            base, found = [], []
            for t in texts:
                by_kind = base_spans(t)
                spans = [(k, a, b) for k, part in enumerate(by_kind) for a, b in part]
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                more = [(_kind(t[a:b]), a, b) for a, b in candidates(t, [(a, b) for _, a, b in spans])] if t and _DIGIT.search(t) else []
                found.append([{"kind": k, "base": i < len(spans), "start": a, "end": b, "value": t[a:b], "patterns": patterns(t, a, b)} for i, (k, a, b) in enumerate(spans + more)])
            return ids, keys, base, found

        return step

    return map_slices(docs, ["doc_id", "text", text_key("text").alias("key")], _BASE, start)


def lower_end(k: Column, n: Column, z: float = Z) -> Column:
    """The lower end of Wilson's interval of a share of k in n."""
    p, zz = k / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def _sure(values: DataFrame, trusted: DataFrame, keys: list[str], accept: float) -> DataFrame:
    """keys and kind of what trusted patterns make sure enough: by the best pattern on each side, as if sides erred independently. values: keys, pattern."""
    sides = values.join(trusted, "pattern").groupBy(*keys, "kind", F.substring("pattern", 1, 1).alias("side")).agg(F.max("score").alias("score"))
    sure = sides.groupBy(*keys, "kind").agg((1 - F.exp(F.sum(F.log(F.lit(1.0) - F.least("score", F.lit(0.99)))))).alias("sure")).where(F.col("sure") >= accept)
    return sure.groupBy(*keys).agg(F.max_by("kind", F.struct("sure", -F.col("kind"))).alias("kind"))


def discover(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, accept: float = VALUE_CONFIDENCE) -> DataFrame:
    """Trusted (pattern, kind, score) of the distinct edges (pattern, value, kind; kind -1: unknown), once no pattern is new.

    Each round joins on values and patterns and sums on both sides, so a pattern
    or value with many edges is summed before it is shuffled. A pattern's score
    is the lower end of the share of its distinct values that are known to be of
    the kind; values are made known by :func:`_sure`.
    """
    seeds = edges.where("kind >= 0").select("value", "kind").distinct()
    each = edges.select("pattern", "value").distinct()
    size = stored(each.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support), "pii-sizes")
    known, trusted, n = seeds, None, -1
    for _ in range(rounds):
        hits = each.join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("k"))
        rated = hits.where(F.col("k") >= support).join(size, "pattern").withColumn("score", lower_end(F.col("k"), F.col("n")))
        trusted = stored(rated.where(F.col("score") >= confidence).select("pattern", "kind", "score"), "pii-patterns")
        before, n = n, trusted.count()
        if n == max(before, 0):
            break
        open_edges = edges.where("kind < 0").select("pattern", "value").distinct()
        known = stored(seeds.unionByName(_sure(open_edges, trusted, ["value"], accept)).distinct(), "pii-values")
    return trusted


def find(docs: DataFrame, accept: float = VALUE_CONFIDENCE, **settings) -> DataFrame:
    """doc_id, ``base`` and ``added``: arrays of (kind, start, end) in order of kind and start, for every row of docs."""
    scan = stored(_scan(docs), "pii-scan")
    places = scan.select("doc_id", "key", F.explode("found").alias("f")).select("doc_id", "key", "f.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges = stored(places.select("pattern", "value", "kind").distinct(), "pii-edges")
    trusted = discover(edges, accept=accept, **settings)
    sure = _sure(places.where("not base").select("doc_id", "key", "start", "end", "pattern"), trusted, ["doc_id", "key", "start", "end"], accept)
    added = sure.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    out = scan.drop("found").join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast(f"array<{_SPAN}>")).alias("added"))


def report(docs: DataFrame, **settings) -> DataFrame:
    """The digest of :func:`find`: doc_id, counts of base spans by kind, base_sha256 and spans (all of them)."""
    names = F.array(*(F.lit(k) for k in KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint").alias(f"n_{KINDS[i]}")
    out = find(docs, **settings)
    return out.select("doc_id", *(count(i) for i in range(4)), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("bigint").alias("n_added"))
