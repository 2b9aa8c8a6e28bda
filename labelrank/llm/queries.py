"""Queries of this subpackage on the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelrank.llm import collocations, contamination, exactdedup, langid, mixing, ngramjoin, quality, repeats, simhash, spelling, tokencount, tokenids, urlfilter
from labelrank.llm.tables import NO_ID, crc_fold, written
from labelrank.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query()
def op1_language_id(spark, sf_dir):
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_fold() != 0))
    found = langid.predict(docs, model)
    return found.select("doc_id", (crc_fold() == 0).alias("held_out"), "lang_pred", "score")


@query()
def op3_token_counts(spark, sf_dir):
    """Tokens of every document by the 32k piece vocabulary."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op6_quality_classifier(spark, sf_dir):
    """Quality score of every document, learned from the labelled rows that are not held out."""
    stats = written(quality.statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    train = stats.where(crc_fold() != 0).join(labels, F.col("doc_id") == F.col("_id")).select("doc_id", "statistics", "label")
    scored = quality.score(stats, quality.fit(train))
    return scored.select("doc_id", (crc_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(sql=r"""
with recursive rows as (
  select doc_id, source, md5('42:' || coalesce(cast(doc_id as varchar), '')) k,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size
  from documents
),
sources as (
  select source, cast(sum(size) as bigint) source_size,
         case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double weight
  from rows group by source
),
levels as (
  select 0 round, (select sum(source_size) / sum(weight) from sources) level
  union all
  select round + 1, (select (sum(source_size) - coalesce(sum(case when weight * level > 3 * source_size then 3 * source_size end), 0))
                            / sum(case when weight * level <= 3 * source_size then weight end) from sources)
  from levels where round < (select count(*) from sources)
),
targets as (
  select source, source_size, least(weight * (select level from levels order by round desc limit 1), 3.0 * source_size) target from sources
),
placed as (
  select doc_id, source, size, coalesce(sum(size) over (partition by source order by k, size rows between unbounded preceding and 1 preceding), 0) before
  from rows
)
select doc_id, size, source_size, target,
       cast((cast(round(target) as bigint) // source_size) * size
            + greatest(0, least(size, cast(round(target) as bigint) % source_size - before)) as bigint) taken
from placed p join targets t on p.source is not distinct from t.source
""")
def op4_mix_sources(spark, sf_dir):
    """Words that the mixture of all sources takes from every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op2_token_ids(spark, sf_dir):
    """Token ids of every document, written as shards and read back."""
    folder = scratch_path(spark, "token-ids")
    tokenids.write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return tokenids.read_documents(spark, folder)



def _number(digest: str) -> F.Column:
    return F.expr(f"cast(conv(substr({digest}, 1, 8), 16, 10) as bigint)")


FIRST_DAY = "2019-01-01"
DAYS = 1461


@query(sql=rf"""
with caps as (
  select page_id, url, date '{FIRST_DAY}' + cast(cast('0x' || substr(md5('fetch:' || page_id), 1, 8) as bigint) % {DAYS} as int) d,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '') host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) path
  from pages
),
parts as (select *, string_split(host, '.') l, list_filter(string_split(path, '/'), lambda s: s <> '') s from caps),
keys as (
  select page_id, host, d, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(2, len(l))), lambda i: array_to_string(l[i:], '.')),
    list_transform(range(1, least(2, len(s)) + 1), lambda i: host || '/' || array_to_string(s[:i], '/'))))) k
  from parts where host is not null
),
logs as (
  select case when n % 4 = 3 then 'allow' else 'block' end list, key, date '{FIRST_DAY}' + cast(n // 16 % {DAYS} as int) as day,
         case when n % 3 = 0 then 'remove' else 'add' end as action
  from (select k as key, cast('0x' || substr(md5(t || ':' || k), 1, 8) as bigint) n
        from (select distinct k from keys) cross join (values ('a'), ('b'), ('c')) v(t))
  where n % 5 < 3
),
days as (select list, key, day, max(case when action = 'remove' then 1 else 0 end) off from logs group by all),
changes as (
  select * from (select *, coalesce(lag(off) over (partition by list, key order by day), 1) was from days) where off <> was
),
active as (select list, key, day since, until, off from (select *, lead(day) over (partition by list, key order by day) until from changes) where off = 0),
hits as (
  select page_id, list, k from keys join active on k = key and d >= since and (until is null or d < until)
),
found as (
  select page_id, count(*) n_active,
         max(case when list = 'block' then {{'n': length(k), 'k': k}} end) b, max(case when list = 'allow' then {{'n': length(k), 'k': k}} end) a
  from hits group by page_id
)
select c.page_id, c.host, cast(c.d as varchar) as day, coalesce(n_active, 0) n_active, b.k blocked_by, a.k allowed_by,
       b is null or coalesce(a.n >= b.n, false) kept
from caps c left join found f on c.page_id = f.page_id
""")
def op7_url_filters(spark, sf_dir):
    """Every capture against the dated lists. The pages have no dates and no lists come with them, so the day of
    a capture, and three dated entries for part of the keys that occur (paths of up to two segments), come from hashes of
    ids and keys."""
    caps = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), (_number("md5(concat('fetch:', page_id))") % DAYS).cast("int")).alias("day"))
    keys = caps.select(F.explode(urlfilter.keys_of(F.col("url"), 2)).alias("key")).distinct()
    logs = keys.select("key", F.explode(F.array(*[F.lit(t) for t in "abc"])).alias("t")).select("key", _number("md5(concat(t, ':', key))").alias("n"))
    logs = logs.where("n % 5 < 3").select(
        F.when(F.col("n") % 4 == 3, urlfilter.ALLOW).otherwise(urlfilter.BLOCK).alias("list"), "key",
        F.date_add(F.lit(FIRST_DAY).cast("date"), (F.floor(F.col("n") / 16) % DAYS).cast("int")).alias("day"),
        F.when(F.col("n") % 3 == 0, "remove").otherwise("add").alias("action"))
    found = urlfilter.evaluate(caps, written(urlfilter.intervals(logs), "lists"), "page_id", "url", "day")
    return found.select(F.col("capture_id").alias("page_id"), "host", F.col("day").cast("string").alias("day"), "n_active", "blocked_by", "allowed_by", "kept")


@query(sql=r"""
with w as (
  select 'd' kind, doc_id id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), ' '), lambda x: x <> '') w from documents
  union all
  select 'b', item_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), ' '), lambda x: x <> '') from benchmark
),
runs as (
  select distinct kind, id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) r from w where len(w) > 0
),
items as (select id, count(*) n from runs where kind = 'b' group by id),
shared as (
  select d.id doc_id, b.id item_id, count(*) s from runs d join runs b on d.r = b.r where d.kind = 'd' and b.kind = 'b' group by all
)
select doc_id, item_id, n item_runs, s shared_runs, s / n containment from shared join items on id = item_id where s >= 0.8 * n - 1e-9
""")
def op8_benchmark_decontamination(spark, sf_dir):
    """Benchmark items found in documents."""
    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op9_simhash_fingerprints(spark, sf_dir):
    """Fingerprints of every document and its edited text, and how alike they are.

    ``n_near`` counts the other documents whose fingerprints lie within 3 bits, found with the block tables, for
    the documents whose id is divisible by 100.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = simhash.edits(docs)
    paired = simhash.edit_fingerprints(edited)
    facts = edited.select("_k", "_h", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "prev_k", "prev_h")
    rows = written(facts.join(paired, ["_k", "_h"]), "fingerprints")
    nexts = rows.select(F.col("prev_k").alias("_k"), F.col("prev_h").alias("_h"), F.col("own").alias("next")).distinct()
    per_print = rows.groupBy(F.col("own").alias("match")).agg(F.count(F.lit(1)).alias("n"))
    asked = rows.where("_k % 100 = 0").select(F.col("own").alias("fingerprint"))
    near = simhash.search(asked, rows.select(F.col("own").alias("fingerprint"))).join(per_print, "match")
    near = near.groupBy(F.col("fingerprint").alias("own")).agg((F.sum("n") - 1).alias("n_near"))
    out = rows.join(nexts, ["_k", "_h"]).join(near, "own", "left")
    return out.select(
        F.when(F.col("_k") != NO_ID, F.col("_k")).alias("doc_id"), "n_chars", "edited_sha256", simhash.shown(F.col("own")).alias("fingerprint"),
        simhash.shown(F.col("edit")).alias("edited_fingerprint"), simhash.likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        simhash.likeness(F.col("own"), F.col("next")).alias("near_next"), F.when(F.col("_k") % 100 == 0, F.col("n_near")).alias("n_near"))


@query()
def op10_repeated_strings(spark, sf_dir):
    """What is left of every document without the 200-byte strings that occur more than once."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query()
def op5_ngram_jaccard_join(spark, sf_dir):
    """Classes of documents linked by 3-word runs with a similarity of 0.9 or more."""
    return ngramjoin.classes(table(spark, sf_dir, "documents"), width=3, similarity=Fraction(9, 10))


@query(sql="""
with rows as (select doc_id, coalesce(text, '') t from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
       row_number() over (partition by t order by doc_id desc nulls last) = 1 kept, sha256(t) text_sha256
from rows
""")
def op12_exact_dedup(spark, sf_dir):
    """Every document with the document that stays of those with its text."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return exactdedup.groups(table(spark, sf_dir, "documents"), carry={"text_sha256": digest})


@query()
def op11_spelling_variants(spark, sf_dir):
    """Frequent words with the words one edit away that are much more frequent."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query(sql=r"""
with pieces as (
  select row_number() over () piece, lang, p
  from (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents)
),
words as (select piece, lang, unnest(w) w, unnest(range(1, len(w) + 1)) i from (select piece, lang, regexp_extract_all(p, '[^\x20\x09]+') w from pieces)),
runs as (
  select lang, w, lead(w, 1) over (partition by piece order by i) w2, lead(w, 2) over (partition by piece order by i) w3 from words
),
f1 as (select lang, w, count(*) n from runs group by all),
totals as (select lang, sum(n) n from f1 group by lang),
f2 as (select lang, w, w2, count(*) a from runs where w2 is not null group by all having count(*) >= 10),
f3 as (select lang, w, w2, w3, count(*) a from runs where w3 is not null group by all having count(*) >= 10),
cuts as (
  select f3.lang, f3.w || ' ' || f3.w2 || ' ' || f3.w3 phrase, f3.a, 1 k, f1.n l, f2.a r
  from f3 join f1 on f1.lang = f3.lang and f1.w = f3.w join f2 on f2.lang = f3.lang and f2.w = f3.w2 and f2.w2 = f3.w3
  union all
  select f3.lang, f3.w || ' ' || f3.w2 || ' ' || f3.w3, f3.a, 2, f2.a, f1.n
  from f3 join f1 on f1.lang = f3.lang and f1.w = f3.w3 join f2 on f2.lang = f3.lang and f2.w = f3.w and f2.w2 = f3.w2
  union all
  select f2.lang, f2.w || ' ' || f2.w2, f2.a, 1, x.n, y.n
  from f2 join f1 x on x.lang = f2.lang and x.w = f2.w join f1 y on y.lang = f2.lang and y.w = f2.w2
  where not exists (select 1 from f3 where f3.lang = f2.lang and f3.w = f2.w and f3.w2 = f2.w2 and 100 * f3.a >= 50 * f2.a)
    and not exists (select 1 from f3 where f3.lang = f2.lang and f3.w2 = f2.w and f3.w3 = f2.w2 and 100 * f3.a >= 50 * f2.a)
),
scored as (select *, cast((1000000 * a::hugeint * a) // (l::hugeint * r) as bigint) score from cuts),
least as (select *, row_number() over (partition by lang, phrase order by score, k) o from scored),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from least where o = 1)
select lang, rank, phrase, a, l, r, cast(totals.n as bigint) n, score from ranked join totals using (lang) where rank <= 2000
""")
def op13_phrase_collocations(spark, sf_dir):
    """The first 2000 phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
