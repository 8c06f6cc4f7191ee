import hashlib
import json
import random

from pyspark.sql import functions as F

from setlist.functions import dates, keys, text


def test_titles():
    cases = {
        "the wheels ON the bus": "The Wheels on the Bus", "what a day: a story": "What a Day: A Story", "a story of one and two": "A Story of One and Two", "de la noche a la mañana": "De la Noche a la Mañana",
        "III years B2B": "III Years B2B", "made in U.S.S.R.": "Made in U.S.S.R.", "r&b/soul nights": "R&b/Soul Nights", "R&B nights": "R&B Nights", "north (feat. someone)": "North", "north [with a choir] (con coro)": "North",
        "north (x south)": "North", "maximum (xylophone)": "Maximum (Xylophone)", "one - two - three": "One", "wait...here it comes": "Wait...Here It Comes", "(don't) stop": "(Don't) Stop", "": None,
    }
    for raw, want in cases.items():
        assert text.title_display(raw) == want, raw
    assert text.fold_case("Ärger  ẞ") == "arger  ss" and text.fold_case(None) is None


def plain_case(title):
    """F10 for one token after the other, by its place."""
    tokens, out = title.split(), []
    for i, t in enumerate(tokens):
        opens = i in (0, len(tokens) - 1) or tokens[i - 1].rstrip("\"'”’)]}").endswith(("...", ":", "?", "!"))
        found = text._CORE.search(t)
        if found is None or text._keeps(t[found.start() :]) or text._keeps(found[0]):
            out.append(t)
            continue
        low = found[0].casefold()
        if opens or low == "so" or low not in text.SMALL_WORDS:
            low = text._OPENING.sub(lambda m: m[0][:-1] + m[0][-1].upper(), found[0].lower())
        out.append(t[: found.start()] + low + t[found.end() :])
    return " ".join(out)


def test_words_of_titles_are_cased_once(monkeypatch):
    class Counted:
        n, core = 0, text._CORE

        def search(self, token):
            self.n += 1
            return self.core.search(token)

    words = [f"unSeen-{c}é." for c in "abcdefgh"]
    titles = [" ".join([*words[i % 8 :], *words[: i % 8]]) for i in range(400)]
    want = [plain_case(t) for t in titles]
    counted = Counted()
    monkeypatch.setattr(text, "_CORE", counted)
    assert [text.title_case(t) for t in titles] == want
    assert counted.n <= len(words)


def test_title_case_when_little_is_remembered(monkeypatch):
    monkeypatch.setattr(text, "_REMEMBERED", 50)
    text._CASED.clear()
    draw = random.Random(5)
    bits = [*"aAbIVxXéÉñÜßİıΣς1²٣ǅ.,:;?!…-–/&+'\"”’()[]{}     ", "...", "so", "the", "THE", "según", "R&B", "ŉ", "U.S.", "x" * 60]
    for _ in range(20_000):
        t = "".join(draw.choices(bits, k=draw.randint(0, 14)))
        assert text.title_case(t) == plain_case(t), t
        assert len(text._CASED) <= 50
    assert max(map(len, text._CASED)) <= text._LONG


def test_base_titles():
    assert text.base_title("Café (Live) - Remastered 2009") == ("cafe", True, False)
    assert text.base_title("Foo-live") == ("foo", True, False)
    assert text.base_title("Song (Club Remix)") == ("song (club remix)", False, True)
    assert text.base_title("(Live)") == ("(live)", True, False)
    assert text.base_title(None) == ("", False, False)
    assert text.fragments("A (Live) [Mono] - Demo") == ["demo", "mono", "live"]
    assert text.protected_tags("A (Live at X) - Live (Demo)") == ["demo", "live"]
    assert text.fold("ÀŁ  é x") == "ał e x"


def test_keys(spark):
    rows = [('A "q"', "é", ["b", " a", "b", None, ""], None), (None, None, None, " x1 ")]
    df = spark.createDataFrame(rows, "artist string, base string, feats array<string>, isrc string")
    key = keys.song_key(F.col("artist"), F.col("isrc"), F.col("base"), F.col("feats"))
    got = df.select(key.alias("k"), keys.song_id(key).alias("id"), keys.guardrail_key(F.col("artist"), F.col("base"), F.col("feats")).alias("g")).collect()
    want = [['A "q"', "é", ["a", "b"]], [None, "X1"]]
    for r, w in zip(got, want, strict=True):
        text_key = json.dumps(w, ensure_ascii=False, separators=(",", ":"))
        assert r.k == text_key and r.id == hashlib.sha1(f"v2.1|{text_key}".encode()).hexdigest()
    assert got[0].g == got[0].k and got[1].g is None


def test_dates(spark):
    df = spark.createDataFrame([("1999",), ("1999-05",), ("1999-05-07",), ("1999-13-45",), ("1999/05",), ("abcd",), ("",), (None,)], "d string")
    got = [tuple(r) for r in df.select(dates.year_of(F.col("d")), dates.precision(F.col("d")), dates.confidence(F.col("d"))).collect()]
    assert got == [(1999, "year", 0.6), (1999, "month", 0.7), (1999, "day", 0.8), (1999, "day", 0.8), (1999, None, None), (None, None, None), (None, None, None), (None, None, None)]
    assert df.agg(F.min(F.struct(dates.sort_key(F.col("d")).alias("k"), "d"))).first()[0].d is None
    first = df.where(dates.sort_key(F.col("d")).isNotNull()).agg(F.min_by("d", dates.sort_key(F.col("d")))).first()[0]
    assert first == "1999-05-07"
    n = spark.createDataFrame([(" 1988 ",), ("19x5",), ("1990.0",), ("",), (None,), ("3,5 x",)], "t string").select(dates.lenient_int(F.col("t")), dates.lenient_number(F.col("t"))).collect()
    assert [tuple(r) for r in n] == [(1988, 1988.0), (None, 19.0), (None, 1990.0), (None, None), (None, None), (None, 3.5)]


def test_artists(spark):
    cases = {
        "Solo": ["Solo"], "One Ft. Two": ["One", "Two"], "One feat Two, Three": ["One", "Two", "Three"], "Crafty Featuring Soft | Left": ["Crafty", "Soft", "Left"], "x|y": ["x", "y"], " ": [], "Daft Feature": ["Daft Feature"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert [r[0] for r in df.select(text.split_artists(F.col("d"))).collect()] == list(cases.values())
    owners = spark.createDataFrame([("a| b||c",), (None,)], "o string").select(text.owners_split(F.col("o"))).collect()
    assert [r[0] for r in owners] == [["a", "b", "c"], []]


def test_registered_udfs(spark):
    text.register(spark)
    r = spark.sql("select fold_ascii('Ñandú') f, title_display('hey - live') t, title_fragments('x (Live)') g").first()
    assert (r.f, r.t, r.g) == ("nandu", "Hey", ["live"])
