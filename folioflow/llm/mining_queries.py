"""Resampling, collocations and mixing as queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .importance_resampling import resample
from .phrase_mining import collocations
from .source_mixing import SEEDS, taken_words


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op11_importance_resampling, op12_phrase_mining, op13_source_mixing)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _nibbles() -> list[int]:
    """The checksum's table by half bytes, from its polynomial."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def _resampling_sql() -> str:
    step = f"xor(x >> 4, {_nibbles()}[cast(xor(x, y) & 15 as int) + 1])"
    half = "instr('0123456789ABCDEF', h[{}]) - 1"
    return f"""with t as (select 0 as side, row_number() over () as row_id, doc_id, {_LOWER} as text from documents union all select 1, row_number() over (), null, {_LOWER} from benchmark),
    w as (select side, row_id, doc_id, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from t),
    f as (select side, row_id, array_to_string(ws[i:i + k - 1], ' ') as f from (select side, row_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w cross join (values (1), (2), (3)) v(k))),
    n as (select side, row_id, f, count(*) as n from f group by all),
    u as (select f, hex(encode(f)) as h from (select distinct f from n)),
    b as (select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(h) + 1), lambda i: cast(case when i % 2 = 1 then instr('0123456789ABCDEF', h[i + 1]) else instr('0123456789ABCDEF', h[i - 1]) end - 1 as bigint))), lambda x, y: {step}), 4294967295::bigint) % 10000 as bucket from u),
    c as (select side, row_id, bucket, sum(n) as n from n join b using (f) group by all),
    s as (select bucket, sum(case when side = 0 then n else 0 end)::double as s, sum(case when side = 1 then n else 0 end)::double as t from c group by 1),
    g as (select bucket, floor(1000 * ln((t + 1) * ((select sum(s) from s) + 10000) / ((s + 1) * ((select sum(t) from s) + 10000))))::bigint as gain from s),
    weighed as (select row_id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from c join g using (bucket) where side = 0 group by 1),
    scored as (select doc_id, len(ws) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296.0::double)))::bigint as score from (select * from w where side = 0) w left join weighed using (row_id)),
    ranked as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) filter (n_words >= 20) over () as able from scored)
    select doc_id, n_features, weight, score, case when n_words >= 20 and place <= able * 5 // 100 then place end as rank from ranked"""


def _phrases_sql() -> str:
    return f"""with pieces as (select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') as ws from documents),
    runs as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as p from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from pieces cross join (values (1), (2), (3)) v(k))),
    f as materialized (select lang, k, p, count(*) as f from runs group by all),
    total as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
    cand as materialized (select lang, k, p, f as a, string_split(p, ' ') as ws from f where k > 1 and f >= 10),
    parts as materialized (select lang, k, p, a, cut, array_to_string(ws[1:cut], ' ') as head, array_to_string(ws[cut + 1:k], ' ') as tail from (select *, unnest(range(1, k)) as cut from cand)),
    cuts as (select c.*, x.f as l, y.f as r, (c.a::hugeint * c.a * 1000000 // (x.f::hugeint * y.f))::bigint as score from parts c join f x on x.lang = c.lang and x.p = c.head join f y on y.lang = c.lang and y.p = c.tail),
    low as (select * from cuts qualify row_number() over (partition by lang, p order by score, cut) = 1),
    longer as (select lang, p, max(a) as longer from (select lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as p from cand where k = 3) group by all),
    kept as (select low.*, low.p as phrase from low left join longer i on i.lang = low.lang and i.p = low.p where i.longer is null or 100 * i.longer < 50 * a),
    best as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
    select best.lang, rank, phrase, a, l, r, n, score from best join total using (lang) where rank <= 2000"""


def _mixing_sql() -> str:
    return f"""with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size from documents),
    s as (select source, sum(size)::bigint as source_size from d group by 1),
    w as (select *, 2.0::double * source_size as most, [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)]::double as weight from s),
    o as (select *, sum(most) over p as held, sum(weight) over () - sum(weight) over p as free, 1.5::double * sum(source_size) over () as total, sum(weight) over () as weights from w window p as (order by most / weight, source rows unbounded preceding)),
    -- The target of a unit of weight is the highest that any number of full sources would leave to the others.
    level as (select max(greatest(total / weights, case when free > 0 then (total - held) / free else 0 end)) as level from o),
    t as (select source, source_size, least(most, level * weight) as target from w cross join level),
    rated as (select *, case when source_size > 0 then least(target / source_size, 2.0::double) else 0 end as rate from t),
    doc as (select d.*, source_size, target, floor(rate) as whole, rate - floor(rate) as fraction, list_transform(range(0, {SEEDS // 8}), lambda k: sha256(k || ':' || coalesce(doc_id::varchar, ''))) as hs from d join rated r on r.source is not distinct from d.source),
    drawn as (select *, list_transform(range(0, {SEEDS}), lambda j: (('0x' || substr(hs[j // 8 + 1], cast(j % 8 * 8 + 1 as int), 8))::bigint + 0.5) / 4294967296.0::double < fraction) as more from doc),
    sums as (select source, j, abs(sum(size * whole) + sum(case when more[j + 1] then size else 0 end) - any_value(target)) as off from drawn cross join range(0, {SEEDS}) x(j) group by 1, 2),
    best as (select source, j from sums qualify row_number() over (partition by source order by off, j) = 1)
    select doc_id, size, source_size, target, cast(size * (whole + case when more[j + 1] then 1 else 0 end) as bigint) as taken from drawn join best on best.source is not distinct from drawn.source"""


def oracle_sql() -> dict[str, str]:
    return {"op11_importance_resampling": _resampling_sql(), "op12_phrase_mining": _phrases_sql(), "op13_source_mixing": _mixing_sql()}
