"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, fingerprint, html_extract, langid, media, neardup, packing, pii, secret_scan, spm, substring, url_filter, vector_codes


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(_documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_documents(spark, sf_dir))


def op3_bpe_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.report(_documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_documents(spark, sf_dir))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(_documents(spark, sf_dir))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(_documents(spark, sf_dir))


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_documents(spark, sf_dir))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_secret_scan": op2_secret_scan,
    "op3_bpe_dropout": op3_bpe_dropout,
    "op4_pii": op4_pii,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_order_minhash": op6_order_minhash,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_mixture_packing": op8_mixture_packing,
    "op9_language_id": op9_language_id,
    "op10_html_extract": op10_html_extract,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_url_filter": op13_url_filter,
}

_KEY = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?"""


def _sql_spans(k: int) -> str:
    """Offsets from the lengths of pieces and matches, as the operator does it."""
    return f"[{{'s': cast(list_sum([length(p) for p in p{k}[1:i]]) + coalesce(list_sum([length(v) for v in v{k}[1:i - 1]]), 0) as bigint), 'ko': {k}, 'v': v{k}[i]}} for i in range(1, len(v{k}) + 1)]"


_SECRET = f"case t.ko when 0 then regexp_replace(t.v, '^{_KEY}', '') else t.v end"
_OP2 = f"""with d as (select doc_id, coalesce(text, '') x, coalesce(source, chr(1)) o, coalesce(lang, chr(1)) g from documents),
  m as (select doc_id, o, g, regexp_extract_all(x, '{_KEY}[A-Za-z0-9+/_.=-]+') v0, string_split_regex(x, '{_KEY}[A-Za-z0-9+/_.=-]+') p0, regexp_extract_all(x, 'AKIA[A-Z0-9]{{12,}}') v1, string_split_regex(x, 'AKIA[A-Z0-9]{{12,}}') p1,
    regexp_extract_all(x, '[0-9a-f]{{32,}}') v2, string_split_regex(x, '[0-9a-f]{{32,}}') p2 from d),
  a as (select doc_id, o, g, list_concat([t for t in {_sql_spans(0)} if length(regexp_replace(t.v, '^{_KEY}', '')) >= 8], list_concat({_sql_spans(1)}, {_sql_spans(2)})) b from m),
  c as (select *, list_distinct([{{'s': t.s + length(t.v) - length({_SECRET}), 'e': t.s + length(t.v), 'w': {_SECRET}, 'k': t.ko, 'pw': regexp_matches(t.v, '^(?i)passw')}} for t in b]) cands from a),
  e as (select doc_id, o, g, unnest(cands) q from c),
  looked as (select doc_id, o, g, q, len(list_distinct(string_split(q.w, ''))) >= 8 and not regexp_matches(q.w, '(?i)(example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|test|foobar|123456)')
    and (q.k = 1 or (q.k = 0 and q.pw) or (regexp_matches(q.w, '[0-9]') and regexp_matches(q.w, '[A-Za-z]'))) looks from e),
  verdict as (select q.w w, count(distinct o) n_o, count(distinct (o, g)) n_r, bool_or(looks) looks from looked group by 1),
  judged as (select doc_id, q, n_o, n_r, n_o <= 2 and n_r <= 3 rare, looks from e join verdict on w = q.w),
  per as (select doc_id, list(distinct {{'s': q.s, 'ko': 3, 'e': q.e, 'k': 'live'}}) filter (rare and looks) l, count(distinct q.w) filter (not rare) n_common, max(n_o) max_owners, max(n_r) max_repos from judged group by doc_id),
  f as (select c.doc_id, b, list_sort([{{'s': t.s, 'ko': t.ko, 'e': t.s + length(t.v), 'k': ['assign', 'access', 'hex'][t.ko + 1]}} for t in b]) base, coalesce(l, []) l, coalesce(n_common, 0) n_common, coalesce(max_owners, 0) max_owners, coalesce(max_repos, 0) max_repos from c left join per on per.doc_id = c.doc_id)
  select doc_id, len([t for t in b if t.ko = 0]) n_assign, len([t for t in b if t.ko = 1]) n_access, len([t for t in b if t.ko = 2]) n_hex, sha256(array_to_string([concat_ws(':', t.k, t.s, t.e) for t in base], ',')) base_sha256,
    array_to_string([concat_ws(':', t.k, t.s, t.e) for t in list_sort(list_concat(base, l))], ',') spans, len(l) n_live, n_common, max_owners, max_repos from f"""



def _op11() -> str:
    """Six rounds over codebooks of sixteen entries, one step after the other."""
    distance = "cast(list_sum(list_transform(list_zip(p.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    steps = []
    for r in range(7):
        steps.append(f"a{r} as materialized (select vec_id, p.part, min({{'d': {distance}, 'e': c.entry}}) b from p join c{r} c on c.part = p.part group by 1, 2)")
        if r < 6:
            steps.append(f"""m{r} as (select part, b.e entry, i, cast(sum(q[i]) as bigint) s, count(*) n from a{r} join p using (vec_id, part), range(1, w + 1) t(i) group by 1, 2, 3),
  k{r} as (select part, entry, list((s - (((s % n) + n) % n)) // n order by i) q from m{r} group by 1, 2),
  c{r + 1} as materialized (select part, entry, coalesce(k{r}.q, c{r}.q) q from c{r} left join k{r} using (part, entry))""".replace("range(1, w + 1)", "range(1, (select max(len(q)) from p) + 1)"))
    return f"""with v as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) ints from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  p as materialized (select vec_id, part, ints[part * len(ints) // 8 + 1 : (part + 1) * len(ints) // 8] q from v, range(8) t(part)),
  c0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 entry, q from p qualify entry < 16),
  {", ".join(steps)},
  e as (select vec_id, string_agg(printf('%02x', b.e), '' order by part) code, cast(sum(b.d) as bigint) error from a6 group by 1),
  f as (select vec_id, code, error, label from e join v using (vec_id)),
  h as (select sha256(string_agg(array_to_string(q, ','), ',' order by part, entry)) codebooks_sha256 from c6)
  select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, codebooks_sha256 from f, h"""


_BIT = {c: 1 << i for i, c in enumerate("ABCDE")}
_FAILS = " + ".join(f"case when {c} then {b} else 0 end" for c, b in _BIT.items())
_OP12 = rf"""with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') x from documents),
  w as (select *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') ws, min(doc_id) over (partition by x) first_id from d),
  j as (select doc_id, part, len(ws) < 100 as "A", 100 * len(list_distinct(ws)) < 80 * len(ws) as "B", 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) as "C", regexp_matches(x, '[#$%&*|]') as "D", doc_id > first_id as "E" from w),
  l as (select doc_id, max(quality) = 1 good, max(toxic) = 1 toxic from labels group by 1),
  m as (select part, {_FAILS} mask, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from j left join l using (doc_id) group by 1, 2),
  letter as (select unnest(['A', 'B', 'C', 'D', 'E']) f, unnest([1, 2, 4, 8, 16]) bit),
  orders as (select [a.f, b.f, c.f, d.f, e.f] fs from letter a, letter b, letter c, letter d, letter e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
  steps as (select array_to_string(fs, '') filter_order, step, (select bit from letter where f = fs[step]) own, coalesce((select sum(bit) from letter where list_contains(fs[1 : step - 1], f)), 0) earlier from orders, range(1, 6) t(step)),
  r as (select part, filter_order, step, own, sum(n) filter (mask & earlier = 0 and mask & own = 0) kept, sum(n) filter (mask & earlier = 0 and mask & own <> 0) removed, sum(n) filter (mask & earlier <> 0 and mask & own <> 0) redundant,
    sum(n) filter (mask = own) unique_fails, sum(good) filter (mask & earlier = 0 and mask & own <> 0) good_lost, sum(toxic) filter (mask & earlier = 0 and mask & own <> 0) toxic_lost
    from (select m.*, filter_order, step, own, cast(earlier as int) earlier from m, steps) group by 1, 2, 3, 4)
  select part, filter_order, cast(step as int) step, {", ".join(f"cast(coalesce({c}, 0) as bigint) {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
    cast(sum(coalesce(removed, 0)) over (partition by part, own) as bigint) shapley from r"""


def _op13() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r.host + r.path))
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    rule = "case " + " ".join(f"when {fits(r)} then '{r.host}{r.path}'" for r in rules) + " end"
    said = "case " + " ".join(f"when {fits(r)} then '{r.verdict}'" for r in rules) + " end"
    long = ", ".join(f"'{s}'" for s in url_filter.SUFFIXES)
    level = lambda of: f"""select case when t <= 0 or t is null then {url_filter.STRONGEST} when (s - a) / t <= 0 then {url_filter.STRONGEST} else least({url_filter.STRONGEST}, greatest({url_filter.WEAKEST}, t / (s - a) - 1)) end k
    from (select sum(n * pow(bad / n - prior, 2)) s, sum(prior * (1 - prior)) a, sum(prior * (1 - prior) * (n - 1)) t from {of} where n > 0)"""  # noqa: E731
    return rf"""with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
  s as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') raw from u),
  p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path from s),
  o as (select doc_id page_id, max(case when coalesce(quality = 0, false) or coalesce(toxic = 1, false) then 1 else 0 end) bad from labels where doc_id is not null and coalesce(quality, toxic) is not null group by 1),
  h0 as (select host, string_split(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', ''), '.') b, count(bad) n, coalesce(sum(bad), 0) bad from p left join o using (page_id) group by 1),
  h1 as (select *, array_to_string(b, '.') nm, array_to_string(b[greatest(1, len(b) - 1) :], '.') two, array_to_string(b[greatest(1, len(b) - 2) :], '.') three from h0),
  h2 as (select host, n, bad, case when len(b) < 2 or regexp_matches(nm, '(^\[|\.[0-9]+$)') then nm when two in ({long}) then three else two end dom, case when len(b) < 2 or regexp_matches(nm, '(^\[|\.[0-9]+$)') then nm when two in ({long}) then two else b[-1] end suf from h1),
  g as (select (coalesce(sum(bad), 0) + 0.5::double) / (coalesce(sum(n), 0) + 1) overall from h2),
  x0 as (select suf, sum(n) n, sum(bad) bad, any_value(overall) prior from h2, g group by 1), xk as ({level("x0")}), x as (select suf, (bad + k * prior) / (n + k) mean from x0, xk),
  d0 as (select dom, suf, sum(n) n, sum(bad) bad, any_value(mean) prior from h2 join x using (suf) group by 1, 2), dk as ({level("d0")}), d as (select dom, (bad + k * prior) / (n + k) mean from d0, dk),
  y0 as (select host, n, bad, mean prior from h2 join d using (dom)), yk as ({level("y0")}), y as (select host, n, bad, k, (bad + k * prior) / (n + k) mean from y0, yk),
  z as (select host, n, bad, mean - {url_filter.Z} * sqrt(mean * (1 - mean) / (n + k + 1)) bound from y)
  select page_id, host, path, {rule} as "rule", coalesce({said}, case when bound > {url_filter.MAX_BAD} then 'block' else 'allow' end) verdict, cast(n as bigint) n_labelled, cast(bad as bigint) n_bad, round(bound, 6) bad_bound from p join z using (host)"""


#: The other operators' columns (token ids, checksums of other forms, spans with possessive
#: patterns, bytes) have no SQL form, or one that is too slow on whole tables; tests compare them
#: with brute force.
ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _op11(),
    "op12_filter_audit": _OP12,
    "op13_url_filter": _op13(),
    "op2_secret_scan": _OP2,
    "op7_minhash_neardup": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
  s as (select doc_id, case when len(ws) >= 5 then list_distinct([array_to_string(ws[i : i + 4], ' ') for i in range(1, len(ws) - 3)]) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end sh from w),
  e as (select doc_id, len(sh) n, unnest(sh) g from s),
  links as (select a.doc_id x, b.doc_id y from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
  reach as (select doc_id, doc_id r from documents union select reach.doc_id, y from reach join links on x = r)
  select doc_id, any_value(len(sh)) n_shingles, min(r) component_id, min(r) = doc_id kept from reach join s using (doc_id) group by doc_id""",
}
