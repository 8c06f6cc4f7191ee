"""Title and artist text.

What needs Unicode decomposition or a peel-until-done loop is an Arrow-batched UDF over small
plain functions; apply these to distinct titles. The rest are column expressions.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import norm, norm_list

# Endings that do not make another song.
COLLAPSIBLE = re.compile(
    r"radio edit|edit|remaster(?:ed)?(?: \d{2,4})?|live(?: .*)?|acoustic(?: .*)?|mono|stereo|instrumental|karaoke|demo|bonus track|version|from .+|soundtrack(?: version)?|ost(?: version)?|theme(?: from .+)?"
)
# Endings that keep a recording apart after the merge.
PROTECTED = {"live": r"live(?: .*)?", "acoustic": r"acoustic(?: .*)?", "instrumental": "instrumental", "karaoke": "karaoke", "demo": "demo", "mono": "mono", "stereo": "stereo"}
# Words of a bracket that names collaborators.
COLLABORATION = ["feat", "ft", "featuring", "with", "con", "w/", "junto a"]
COLLABORATION_X = re.compile(r"(^|\s)x(\s|$)")
# Words that stay small inside a title, English then Spanish.
SMALL_WORDS = frozenset(
    "a an and as at but by for from in into nor of off on onto or out over per so the to up upon via with yet vs v "
    "al ante bajo cabe con contra de del desde durante en entre hacia hasta mediante para por según sin sobre tras versus y e o u ni el la los las lo un una unos unas".split()
)
# Names of albums that carry the date of a reissue.
REISSUE = r"\b(remaster\w*|deluxe|anthology|antologia|greatest hits|best of|collection|coleccion|recopilat\w*|singles|hits|essential\w*|live|en directo|en vivo|edition|edicion|aniversario|anniversary)\b"

_EDGE = " -:;,.!/'\""
_BRACKETS = (("(", ")"), ("[", "]"))
_DASHED = re.compile(r"\s*[-:]\s*([^-:()\[\]]+)\s*$")


def fold(text: str | None) -> str:
    """Decomposed, without marks, lower case, single blanks."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return " ".join(bare.lower().split())


def fold_case(text: str | None) -> str | None:
    """Decomposed, without marks, case folded, blanks as they are."""
    return None if text is None else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def _endings(title: str):
    """``(rest, ending)`` for each way in which the title ends: brackets, then a dash or colon."""
    end = title.rstrip()
    for opening, closing in _BRACKETS:
        if end.endswith(closing):
            at = end.rfind(opening, 0, len(end) - 1)
            inner = end[at + 1 : -1]
            if at >= 0 and not set(inner) & {opening, closing}:
                yield end[:at].rstrip(), inner
    if m := _DASHED.search(title):
        yield title[: m.start()], m[1]


def fragments(title: str | None) -> list[str]:
    """Folded endings of a title, the last one first."""
    out, rest = [], (title or "").strip()
    while rest and (step := next(_endings(rest), None)):
        tag = fold(step[1]).strip(_EDGE)
        if tag:
            out.append(tag)
        rest = step[0].strip()
    return out


def protected_tags(title: str | None) -> list[str]:
    found = [name for f in fragments(title) for name, p in PROTECTED.items() if re.fullmatch(p, f)]
    return list(dict.fromkeys(found))


def base_title(title: str | None) -> tuple[str, bool, bool]:
    """``(base, had an ending that collapses, says remix)``."""
    whole = fold(title)
    rest, cut = whole, False
    while rest:
        for left, tag in _endings(rest):
            tag = fold(tag).strip(_EDGE)
            if tag and "remix" not in tag and COLLAPSIBLE.fullmatch(tag):
                rest, cut = " ".join(left.strip(_EDGE).split()), True
                break
        else:
            break
    return rest or whole, cut, bool(re.search(r"\bremix\b", whole))


# Letters of English and Spanish; words that keep their capitals (initials, Roman numerals, words with a
# digit, joined capitals); how long other capitals may be that are kept; small words that rise all the same; what may
# close a phrase, and the quotes and brackets that may stand behind it.
_LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
_KEEP = re.compile(r"(?:[A-Z]\.){2,}[A-Z]?\.?|[IVXLCDM]+|.*\d.*|(?=.*[&/+])[A-Z0-9&/+]+(?:-[A-Z0-9&/+]+)*", re.S)
_CAPITALS = 3
_RISING = frozenset(["so"])
_PHRASE_ENDS, _CLOSING = ("...", ":", "?", "!"), "\"'”’)]}"
#: From the first to the last letter or digit of a token, and a letter that opens a word or follows a mark.
_CORE = re.compile(rf"[0-9{_LETTERS}](?:.*[0-9{_LETTERS}])?", re.S)
_OPENING = re.compile(rf"(?:\A|[:?!/-]|\.\.\.)[^{_LETTERS}]*[{_LETTERS}]")
_ENDS = frozenset(re.findall(rf"[{_LETTERS}]", "".join(map(chr, range(256)))))
_STAYING = SMALL_WORDS - _RISING
#: Tokens that a worker remembers, and how long these may be: some tens of megabytes at most.
_REMEMBERED, _LONG = 1 << 16, 40


def _keeps(word: str) -> bool:
    short = len(word) <= _CAPITALS and word.isalpha() and word.isupper()
    return (short or bool(_KEEP.fullmatch(word))) and word.casefold() not in SMALL_WORDS


def _cased(token: str) -> tuple[str, str, bool]:
    """``(as it stands inside a phrase, as it opens or closes one, whether the next one opens one)``; all that a token's
    case depends on besides its place."""
    ends = token.rstrip(_CLOSING).endswith(_PHRASE_ENDS)
    core = token.rstrip(".,")
    if core.isalpha() and core.islower() and core[0] in _ENDS and core[-1] in _ENDS:  # most words: nothing to keep
        before, after = "", token[len(core) :]
    else:
        found = _CORE.search(token)
        if found is None or _keeps(token[found.start() :]) or _keeps(found[0]):
            return token, token, ends
        core, before, after = found[0], token[: found.start()], token[found.end() :]
    low = core.lower()
    # letters alone: the first one is all that opens
    rising = low[0].upper() + low[1:] if core.isalpha() else _OPENING.sub(lambda m: m[0][:-1] + m[0][-1].upper(), low)
    small = core.casefold()
    return before + (small if small in _STAYING else rising) + after, before + rising + after, ends


class _Cased(dict):
    """What :func:`_cased` says of tokens. Starts anew when it is full."""

    def __missing__(self, token: str) -> tuple[str, str, bool]:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = _cased(token)
        if len(token) <= _LONG:
            self[token] = found
        return found


_CASED = _Cased()


def title_case(title: str) -> str:
    """Bilingual title case (F10): small words stay small, but for the first and the last and those that open a phrase."""
    out, opens, rising = [], True, ""
    for token in title.split():
        inside, rising, ends = _CASED[token]
        out.append(rising if opens else inside)
        opens = ends
    return " ".join([*out[:-1], rising])


def title_display(title: str | None) -> str | None:
    """What a card shows: no ``- ...`` tail, no brackets with collaborators, title case."""
    rest = (title or "").strip().split(" - ")[0].strip()
    while rest:
        for opening, closing in _BRACKETS:
            at = rest.rfind(opening, 0, len(rest) - 1) if rest.endswith(closing) else -1
            inner = rest[at + 1 : -1].casefold() if at >= 0 else ""
            if at >= 0 and not set(inner) & {opening, closing} and inner.strip() and (any(k in inner for k in COLLABORATION) or COLLABORATION_X.search(inner)):
                rest = rest[:at].strip()
                break
        else:
            break
    return title_case(rest) or None


def _fold_batch(titles: pd.Series) -> pd.Series:
    return titles.map(fold, na_action="ignore")


def _case_batch(texts: pd.Series) -> pd.Series:
    return texts.map(fold_case, na_action="ignore")


def _parts_batch(titles: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(*base_title(t), protected_tags(t)) for t in titles], columns=["base", "had_suffix", "remix", "protected"])


def _display_batch(titles: pd.Series) -> pd.Series:
    return titles.map(title_display, na_action="ignore")


def _fragments_batch(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: fragments(t) if isinstance(t, str) else [])


def udfs() -> dict:
    """Arrow-batched UDFs by the names under which :func:`register` gives them to SQL."""
    return {
        "fold_ascii": F.pandas_udf(_fold_batch, "string"),
        "fold_case": F.pandas_udf(_case_batch, "string"),
        "title_parts": F.pandas_udf(_parts_batch, "base string, had_suffix boolean, remix boolean, protected array<string>"),
        "title_display": F.pandas_udf(_display_batch, "string"),
        "title_fragments": F.pandas_udf(_fragments_batch, "array<string>"),
    }


def mapped(df: DataFrame, column: str, name: str, out: str) -> DataFrame:
    """``df`` with ``out``: what the UDF ``name`` makes of ``column``. It sees each distinct value once; a null stays one."""
    made = df.select(F.col(column).alias("__value")).where("__value is not null").distinct().withColumn(out, udfs()[name]("__value"))
    return df.drop(out).join(made, F.col(column) == F.col("__value"), "left").drop("__value")


def register(spark) -> None:
    for name, f in udfs().items():
        spark.udf.register(name, f)


def artists_display(primary: Column, others: Column) -> Column:
    """``A feat. B | C``."""
    names = F.array_join(norm_list(others), " | ")
    return F.when(norm(primary).isNull(), F.nullif(names, F.lit(""))).when(names == "", norm(primary)).otherwise(F.concat(norm(primary), F.lit(" feat. "), names))


def canonical_feat(display: Column) -> Column:
    """Every way to write ``feat.`` as that, with single blanks."""
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    return squeeze(F.regexp_replace(squeeze(F.coalesce(display, F.lit(""))), r"(?i)(?<![A-Za-zÀ-ÿ])(?:feat\.?|ft\.?|featuring)(?![A-Za-zÀ-ÿ])", " feat. "))


def split_artists(display: Column) -> Column:
    """Names in a display text."""
    d = canonical_feat(display)
    both = r"(?i)^(.*?)\s+feat\.\s+(.*)$"
    primary, rest = F.trim(F.regexp_extract(d, both, 1)), F.regexp_extract(d, both, 2)
    names = F.when(rest != "", F.concat(F.array(primary), F.split(rest, "[|,]"))).otherwise(F.split(d, "[|]"))
    return F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")


def primary_artist(display: Column) -> Column:
    """What stands before `` feat. ``."""
    return F.trim(F.split_part(display, F.lit(" feat. "), F.lit(1)))


def owners_footer(names: Column) -> Column:
    """``(Ana, Bob)``."""
    return F.concat(F.lit("("), F.array_join(norm_list(names), ", "), F.lit(")"))


def owners_split(text: Column) -> Column:
    """Pipe-joined owners as an array."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[|]"), lambda x: F.trim(x)), lambda s: s != "")


def card_id(prefix: str, owner: Column, number: Column) -> Column:
    """``PREFIX_OWNER_001`` (F16)."""
    return F.concat_ws("_", F.lit(prefix), F.upper(owner), F.format_string("%03d", number.cast("int")))


def track_id_of(payload: Column, host: str) -> Column:
    """The 22-character id in a URI, a bare id or a URL of ``host``."""
    t = F.trim(payload)
    ident = r"([A-Za-z0-9]{22})"
    scheme = host.split(".")[-2]
    found = F.coalesce(
        F.nullif(F.regexp_extract(t, rf"^{scheme}:track:{ident}$", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, rf"^{ident}$", 1), F.lit("")),
        F.when(F.lower(F.try_parse_url(t, F.lit("HOST"))).contains(host), F.nullif(F.regexp_extract(F.try_parse_url(t, F.lit("PATH")), rf"^/(?:[A-Za-z-]+/)?track/{ident}/?$", 1), F.lit(""))),
    )
    return found
