"""Text normalisation for matching names and addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of an address and their short forms.
ADDRESS_WORDS = {
    "STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "ROAD": "RD", "DRIVE": "DR", "LANE": "LN", "COURT": "CT", "PLACE": "PL",
    "HIGHWAY": "HWY", "PARKWAY": "PKWY", "SQUARE": "SQ", "TERRACE": "TER", "WAY": "WAY",
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
    "FIRST": "1ST", "SECOND": "2ND", "THIRD": "3RD", "FOURTH": "4TH", "FIFTH": "5TH", "SIXTH": "6TH", "SEVENTH": "7TH", "EIGHTH": "8TH", "NINTH": "9TH", "TENTH": "10TH",
}
UNIT_CLAUSE = r"\s+(STE|SUITE|UNIT|APT|FL|FLOOR|RM|ROOM)\b.*$"
NAME_NOISE = r"\b(LLC|INC|CORP|CO|LTD|LP|THE|OF|AND|STORE|MART|SHOP)\b|[^A-Z0-9 ]"
# Outlet types and the patterns of their names, first match wins.
OUTLET_RULES = [
    ("tobacco_shop", r"\b(SMOKE|SMOKES|VAPE|VAPES|VAPOR|TOBACCO|CIGAR|CIGARS|HOOKAH|CBD|KRATOM|LIQUID)\b"),
    ("dollar_store", r"DOLLAR|FIVE BELOW|BIG LOTS|99 CENT"),
    ("pharmacy", r"\b(CVS|RITE ?AID|WALGREEN|WALGREENS)\b"),
    ("supermarket", r"ACME|FOOD LION|GIANT EAGLE|GIANT FOOD|\bGIANT\b|KARNS|SAVE[- ]A[- ]LOT|SHOP ?'?N'? ?SAVE|WEIS|ALDI|WHOLE FOODS|TRADER JOE|SHOPRITE|WALMART|WAL[- ]MART|COSTCO|SAM'?S CLUB|SUPERMARKET"),
    ("pharmacy", r"\b(PHARMACY|DRUG|DRUGS)\b"),
    ("convenience_gas", r"7[- ]?ELEVEN|AM ?PM|A[- ]PLUS|CIRCLE K|COGO|CONVENIENT FOOD MART|CROSSROADS|E[- ]?Z MART|GET ?GO|GIT N GO|GO[- ]MART|KWIK FILL|QUICK ?STOP|RUTTER|SHEETZ|STOP[- ]N[- ]GO|STUCKEY|TOWN (AND|&) COUNTRY FOOD|TURKEY HILL|UNI[- ]?MART|WAWA|SUNOCO|SPEEDWAY|SHELL|GULF|\bBP\b|EXXON|MARATHON|CITGO|LUKOIL|MOBIL|ROYAL FARMS|LOVE'?S|PILOT|\bGAS\b|FUEL|PETRO"),
    ("beer_distributor", r"BEER|DISTRIBUTOR|BEVERAGE|\bBEV\b"),
    ("bar_tavern", r"\b(BAR|TAVERN|PUB|LOUNGE|CLUB|INN|SALOON)\b"),
    ("restaurant_deli", r"PIZZA|\bDELI\b|RESTAURANT|GRILL|CAFE|DINER|SUBS?\b|BAKERY|DONUT|COFFEE|CHINESE|KITCHEN|WINGS|BURGER"),
    ("news", r"\bNEWS\b|NEWSSTAND"),
    ("convenience_independent", r"MARKET|GROCER|FOOD ?MART|MINI ?MART|CONVENIENCE|CORNER|MART\b|STORE|SHOP|EXPRESS|QUICK|FOODS?\b"),
]


def normalize_text(c: Column) -> Column:
    """Trimmed, upper case, runs of blanks as one."""
    return F.regexp_replace(F.upper(F.trim(c)), r"\s+", " ")


def normalize_address(c: Column) -> Column:
    """Normalised text without full stops and commas."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_text(c), r"[.,]", ""), r"\s+", " "))


def match_address(c: Column) -> Column:
    """An address for lookups between sources alone: short forms, no unit."""
    bare = F.regexp_replace(F.regexp_replace(normalize_address(c), "#", " "), UNIT_CLAUSE, "")
    short = F.create_map(*[F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair])
    words = F.filter(F.split(bare, r"\s+"), lambda t: t != "")
    return F.array_join(F.transform(words, lambda t: F.coalesce(short[t], t)), " ")


def zip5(c: Column) -> Column:
    """The first five digits in a row, or null."""
    return F.nullif(F.regexp_extract(c, r"(\d{5})", 1), F.lit(""))


def location_key(street: Column, zip_code: Column) -> Column:
    """Street and zip; null if either is."""
    return F.concat(normalize_address(street), F.lit("|"), zip5(zip_code))


def name_key(c: Column) -> Column:
    """A chain's name: without store numbers and signs."""
    letters = F.regexp_replace(F.regexp_replace(F.upper(c), r"[#\d]+", " "), r"[^A-Z& ]", " ")
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def name_tokens(c: Column) -> Column:
    """A name without corporate noise."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), NAME_NOISE, " "), r"\s+", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length: the native stand-in for a sequence matcher's ratio."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def classify_outlet(name: Column) -> Column:
    """The first outlet type whose pattern the name fits, else other."""
    text = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"\s+", " ")
    out = F.lit("other")
    for label, pattern in reversed(OUTLET_RULES):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def classify_outlet_sql(name: str) -> str:
    """The same as SQL."""
    text = f"regexp_replace(upper(coalesce({name}, '')), '\\s+', ' ', 'g')"
    cases = " ".join("WHEN regexp_matches({}, '{}') THEN '{}'".format(text, p.replace("'", "''"), label) for label, p in OUTLET_RULES)
    return f"CASE {cases} ELSE 'other' END"


def sequence_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks over all characters of two texts; 1 if both are empty.

    The longest block that both have (of several the first in a, then in b) counts, and so do, by the same rule, the blocks to its left
    and to its right.  A fold over a list of pairs of parts that are left to match: each step takes one pair and puts back two.  Lists are
    no longer than the shorter text, and a step looks up the parts of a in b, so this is for names, not for documents.
    """
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    part = lambda x, y: F.struct(x.alias("a"), y.alias("b"))

    def step(acc: Column, _: Column) -> Column:
        def matched(w: Column) -> Column:
            x, y = w["a"], w["b"]
            # a block is in y if all shorter ones are, so their number is the length of the longest
            fits = lambda i: F.size(F.filter(F.sequence(F.lit(1), F.least(F.length(x) - i + 1, F.length(y))), lambda k: F.contains(y, F.substr(x, i, k))))
            longest = F.array_max(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.struct(fits(i).alias("n"), (-i).alias("i"))))

            def put_back(m: Column) -> Column:
                i, n = -m["i"], m["n"]
                j = F.position(F.substr(x, i, n), y)
                sides = F.array(part(F.substr(x, F.lit(1), i - 1), F.substr(y, F.lit(1), j - 1)), part(F.substr(x, i + n), F.substr(y, j + n)))
                more = F.filter(sides, lambda s: (F.length(s["a"]) > 0) & (F.length(s["b"]) > 0))
                rest = F.slice(acc["left"], F.lit(2), F.size(acc["left"]))
                return F.struct(F.when(n > 0, F.concat(rest, more)).otherwise(rest).alias("left"), (acc["n"] + n).alias("n"))

            return F.transform(F.array(longest), put_back)[0]

        return F.when(F.size(acc["left"]) > 0, F.transform(F.slice(acc["left"], 1, 1), matched)[0]).otherwise(acc)

    start = F.struct(F.filter(F.array(part(a, b)), lambda s: (F.length(s["a"]) > 0) & (F.length(s["b"]) > 0)).alias("left"), F.lit(0).alias("n"))
    steps = F.sequence(F.lit(0), 2 * F.least(F.length(a), F.length(b)))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.aggregate(steps, start, step)["n"] / total)


_FITS = "list_sort(list_transform(range(1, length({a}) + 1), lambda i: struct_pack(n := len(list_filter(range(1, least(length({a}) - i + 1, length({b})) + 1), lambda k: contains({b}, substr({a}, i, k)))), i := -i)), 'DESC')[1]"


def sequence_ratio_sql(pairs: str, key: str) -> str:
    """The same in SQL: (key, ratio), rounded, from a query of (key, a, b)."""
    return f"""WITH RECURSIVE pairs AS ({pairs}), work({key}, a, b, m) AS (SELECT {key}, a, b, {_FITS.format(a='a', b='b')} FROM pairs WHERE length(a) > 0 AND length(b) > 0 UNION ALL
 SELECT {key}, p.a, p.b, {_FITS.format(a='p.a', b='p.b')} FROM (SELECT {key}, unnest([struct_pack(a := substr(a, 1, -m.i - 1), b := substr(b, 1, instr(b, substr(a, -m.i, m.n)) - 1)), struct_pack(a := substr(a, -m.i + m.n), b := substr(b, instr(b, substr(a, -m.i, m.n)) + m.n))]) AS p FROM work WHERE m.n > 0) WHERE length(p.a) > 0 AND length(p.b) > 0)
 SELECT {key}, round(CASE WHEN length(a) + length(b) = 0 THEN 1 ELSE 2 * coalesce(n, 0) / CAST(length(a) + length(b) AS DOUBLE) END, 6) AS ratio FROM pairs LEFT JOIN (SELECT {key}, sum(m.n) AS n FROM work GROUP BY 1) USING ({key})"""
