"""Operator 6: secrets in texts, with native expressions only.

Three base patterns find assignments, access keys and long hexadecimal runs. Two character
Markov models add spans: one of random strings, one of ordinary identifiers, both trained
from labelled samples. A token is a further secret if its log-likelihood ratio is high.
"""

from __future__ import annotations

import math
import random
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# The base patterns, with the least lengths of what they must match.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Tokens that the models judge: runs of at least RANDOM_LEAST characters of ALPHABET, which
#: is the shortest length that they are trained on; and their parts between "/" and "=",
#: where a run as a whole isn't a secret.
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_-="
RANDOM_LEAST = 16
RANDOM = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{RANDOM_LEAST},}}"
PART = rf"(?<![A-Za-z0-9+_-])[A-Za-z0-9+_-]{{{RANDOM_LEAST},}}"
HAS_PART = rf"[/=][A-Za-z0-9+_-]{{{RANDOM_LEAST}}}|[A-Za-z0-9+_-]{{{RANDOM_LEAST}}}[/=]"
#: Matches whose spans are gathered at a time.
GROUP = 512
#: Least log-likelihood ratio for each bigram, and over the whole token, in nats.
RATIO_EACH, RATIO_WHOLE = 0.8, 8.0

# Words that identifiers are made of in the ordinary samples.
PARTS = (
    "account action address admin agent array batch block buffer build cache call channel check class client code color column config connection content context "
    "copy count create current data date default delete detail device document domain element email enable entry error event export field file filter first "
    "flag folder format function group handler hash header height history hook host image import index info input instance item iterator job key label last "
    "layer length level limit line link list load local lock log main manager map mask message method mode model module month name network node number object offset "
    "option order output package page parent parser password path pattern payload point policy pool position prefix process product profile project property query "
    "queue range record region remote report request reset resource response result role root route rule sample schema scope script search section select sender "
    "server service session setting shape signal size source stage start state status step storage stream string style system table target task test text thread time "
    "title token total trace track type unit update upload user value vector version view widget width window worker year"
).split()


def labelled_samples(n: int = 4000, seed: int = 6) -> list[tuple[str, int]]:
    """(string, 1 for random or 0 for ordinary): n of each, the same for the same seed.

    Random ones are drawn evenly from the alphabets that keys are written in; ordinary ones
    are words in snake, kebab, camel or path form, some with numbers or dates.
    """
    rng = random.Random(seed)
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    kinds = [lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "-_", upper + digits, lower + digits, "0123456789abcdef", "0123456789ABCDEF"]
    out = [("".join(rng.choices(rng.choice(kinds), k=rng.randint(16, 64))), 1) for _ in range(n)]
    for _ in range(n):
        words = rng.choices(PARTS, k=rng.randint(2, 6))
        form = rng.randrange(6)
        if form == 0:
            s = "_".join(words)
        elif form == 1:
            s = "-".join(words)
        elif form == 2:
            s = words[0] + "".join(w.title() for w in words[1:])
        elif form == 3:
            s = "/".join(words)
        elif form == 4:
            s = "_".join(words).upper()
        else:
            s = "".join(words)
        if rng.random() < 0.4:
            s += rng.choice(["", "_", "-", "/"]) + rng.choice([str(rng.randint(0, 9999)), f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"v{rng.randint(1, 20)}"])
        out.append((s, 0))
    return out


def train_ratios(samples: list[tuple[str, int]], smooth: float = 0.5) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for all a, b of the alphabet, row by row."""
    size = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[[smooth] * size for _ in range(size)] for _ in range(2)]
    for s, label in samples:
        for a, b in zip(s, s[1:], strict=False):
            if a in at and b in at:
                counts[label][at[a]][at[b]] += 1
    out = []
    for a in range(size):
        ordinary, rand = sum(counts[0][a]), sum(counts[1][a])
        out += [math.log(counts[1][a][b] / rand) - math.log(counts[0][a][b] / ordinary) for b in range(size)]
    return out


def ratio(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a token over its bigrams, in one pass over its characters."""
    size = len(ALPHABET)
    values = F.array(*[F.lit(round(x, 6)) for x in table])
    place = F.array(*[F.lit(ALPHABET.find(chr(c))) for c in range(128)])

    def step(acc, c):
        at = F.get(place, F.ascii(c))
        more = F.when(acc["at"] >= 0, F.get(values, acc["at"] * size + at)).otherwise(F.lit(0.0))
        return F.struct(at.alias("at"), (acc["sum"] + more).alias("sum"))

    start = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.split(token, ""), start, step)["sum"]


def _spans(text: Column, pattern: str, kind: int, ok) -> Column:
    """Structs (start, kind, end) of all matches for which ok(match, group 2 or match) holds.

    Java's split and match functions give what lies between the matches and the matches
    themselves; their lengths in code points add up to places. Spans are gathered for
    GROUP matches at a time, so that no long list grows by one.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else whole
    none = lambda at: F.struct(at.alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["b"])
        end = start + F.coalesce(F.length(x["w"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["w"].isNotNull() & ok(x["w"], x["v"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def group(found):
        def grow(acc, g):
            own = F.aggregate(F.slice(found, g * GROUP + 1, F.lit(GROUP)), none(acc["at"]), step)
            return let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], o["out"]).alias("out")))

        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / GROUP).cast("int")), none(F.lit(0)), grow)["out"]

    return let(F.arrays_zip(between.alias("b"), whole.alias("w"), value.alias("v")), group)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _clear(spans: Column, of: Column) -> Column:
    """The spans that meet none of the others, by one pass over all in order.

    A span stands at its end, one of the others at its start, and of equal places the spans
    come first: so a span meets another if the furthest end before it is beyond its start.
    The furthest ends are found for groups of places first, so that no long list grows.
    """
    at = lambda place, other, reach, s: F.struct(place.alias("at"), F.lit(other).alias("other"), reach.alias("reach"), s.alias("span"))
    places = F.array_sort(F.concat(F.transform(spans, lambda s: at(s["end"], 0, s["start"], s)), F.transform(of, lambda s: at(s["start"], 1, s["end"], s))))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def judged(acc, p):
        clear = (p["other"] == 0) & (acc["top"] <= p["reach"])
        top = F.when(p["other"] == 1, F.greatest(acc["top"], p["reach"])).otherwise(acc["top"])
        return F.struct(top.alias("top"), F.when(clear, F.concat(acc["out"], F.array(p["span"]))).otherwise(acc["out"]).alias("out"))

    def merged(all_):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / GROUP).cast("int")), lambda g: F.slice(all_, g * GROUP + 1, F.lit(GROUP)))
        tops = lambda c: F.transform(c, lambda x: F.aggregate(x, F.lit(0), lambda a, p: F.when(p["other"] == 1, F.greatest(a, p["reach"])).otherwise(a)))
        before = lambda t: F.aggregate(t, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), x))))
        each = lambda c, b: F.zip_with(c, F.slice(b, 1, F.size(c)), lambda x, top: F.aggregate(x, F.struct(top.alias("top"), empty.alias("out")), judged)["out"])
        return let(chunks, lambda c: let(let(tops(c), before), lambda b: F.flatten(each(c, b))))

    return F.when((F.size(spans) == 0) | (F.size(of) == 0), spans).otherwise(let(places, merged))


def scan_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), table: list[float] | None = None) -> DataFrame:
    """The kept columns, text, and base and spans: arrays of (start, kind, end) of every row.

    Places are code points, ends exclusive. spans has all base spans, and the runs and parts
    of runs that the models add where no base span overlaps. A null text counts as empty. Every row
    gives one row, whatever its id; columns that aren't kept are left out.
    """
    table = table or train_ratios(labelled_samples())
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    t = F.col("_text")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    least = lambda kind: lambda w, v: F.length(v) >= LEAST[kind]
    assign = F.when(t.rlike(ASSIGN), _spans(t, ASSIGN, 0, least("assign"))).otherwise(none)
    access = F.when(t.rlike(r"AKIA[A-Z0-9]{16}"), _spans(t, ACCESS, 1, least("access"))).otherwise(none)
    # runs are whole in any case, so the least length can stand in the pattern itself
    hexes = F.when(t.rlike(r"[0-9a-f]{24}"), _spans(t, r"[0-9a-f]{24,}", 2, least("hex"))).otherwise(none)
    judged = lambda w, v: ratio(w, table) >= F.greatest(F.lit(RATIO_WHOLE), RATIO_EACH * F.length(w))
    more = F.when(t.rlike(rf"[A-Za-z0-9+/_=-]{{{RANDOM_LEAST}}}"), _spans(t, RANDOM, 3, judged)).otherwise(none)
    parts = F.when(t.rlike(HAS_PART), _spans(t, PART, 3, judged)).otherwise(none)
    rows = rows.withColumn("_base", F.concat(assign, access, hexes)).withColumn("_more", more).withColumn("_parts", parts)
    apart = F.concat(_clear(F.col("_more"), F.col("_base")), _clear(_clear(F.col("_parts"), F.col("_base")), F.col("_more")))
    return rows.select(*keep, t.alias("text"), F.array_sort("_base").alias("base"), F.array_sort(F.concat("_base", apart)).alias("spans"))


def digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts by base kind, the base spans' sha256 and all spans as text."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(*keep, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
