"""Contract queries for sources, cleaning and pre-tokenisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import pretokenize as pt
from ..sources import records
from ..tables import NOTES_SQL, notes, table
from .common import (clean_sql, pretokens_sql, register, strip_sql,
                     tok_docs, tok_text_sql, word_count_sql)


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _clean_docs(spark, sf):
    return _docs(spark, sf).select("doc_id", "source", tx.general_clean(F.col("text")).alias("text"))


_tok_docs = tok_docs


# B1 + B2: the flagship ------------------------------------------------------
@register("pretoken_top100", f"""
with t as (select unnest({pretokens_sql(tok_text_sql('text'))}) as token from documents)
select token, count(*)::BIGINT as n from t group by token order by n desc, token limit 100
""")
def pretoken_top100(spark, sf):
    counts = pt.word_counts(_tok_docs(spark, sf))
    return counts.orderBy(F.desc("n"), F.asc("token")).limit(100)


@register("pretoken_counts", f"""
with t as (select unnest({pretokens_sql(tok_text_sql('text'))}) as token from documents)
select token, count(*)::BIGINT as n from t group by token
""")
def pretoken_counts(spark, sf):
    return pt.word_counts(_tok_docs(spark, sf))


@register("pretoken_symbols", f"""
with t as (select distinct unnest({pretokens_sql(tok_text_sql('text'))}) as token from documents)
select token, regexp_replace(hex(encode(token)), '(..)', '\\1 ', 'g') as symbols from t
""")
def pretoken_symbols(spark, sf):
    toks = pt.word_counts(_tok_docs(spark, sf)).select("token")
    # DuckDB twin leaves one trailing space; keep the same rendering here.
    return toks.select("token", F.concat(pt.symbols_of(F.col("token")), F.lit(" ")).alias("symbols"))


@register("vocab_probe", f"""
select count(distinct token)::BIGINT as vocab_estimate
from (select unnest({pretokens_sql(tok_text_sql('text'))}) as token from documents)
""")
def vocab_probe(spark, sf):
    return pt.vocabulary_probe(_tok_docs(spark, sf))


@register("vocab_probe_sources", f"""
with t as (select source, unnest({pretokens_sql(tok_text_sql('text'))}) as token from documents)
select source, false as is_total, count(distinct token)::BIGINT as exact, true as estimate_is_near from t group by source
union all select null, true, count(distinct token), true from t
""")
def vocab_probe_sources(spark, sf):
    """Sizes per source and in all, and whether the estimate is within 5 % of them."""
    p = pt.vocabulary_probe_by(_tok_docs(spark, sf), "source")
    near = F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact") + 1
    return p.select("source", "is_total", "exact", near.alias("estimate_is_near"))


# P1 / S3 ----------------------------------------------------------------------
@register("nonblank_documents", """
select doc_id, source from documents where text is not null and regexp_matches(text, '\\S')
""")
def nonblank_documents(spark, sf):
    return tx.drop_blank(_docs(spark, sf)).select("doc_id", "source")


@register("record_scan", """
select doc_id, text from documents where text is not null and text <> ''
""")
def record_scan(spark, sf):
    return records.record_corpus(_docs(spark, sf), key="doc_id")


# P3 ---------------------------------------------------------------------------
@register("part_text", """
select p_partkey, concat_ws(chr(10), p_name, p_type) as text from part
""")
def part_text(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", tx.extract_text(F.col("p_name"), F.col("p_type")).alias("text"))


# P4 ---------------------------------------------------------------------------
@register("strip_urls_emails", f"""
select doc_id,
  regexp_replace(regexp_replace(text, '{tx.URL_PATTERN}', '', 'g'), '{tx.EMAIL_PATTERN}', '', 'g') as text
from documents
""")
def strip_urls_emails(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", tx.remove_urls_emails(F.col("text")).alias("text"))


# P5: the twin has NFC in place of NFKC, which is the same on texts without compatibility
# characters, as the table's are; without look-around it parts the text at all marks and leaves
# out those that stand between a digit and three digits
@register("normalised_documents", r"""
with t as (select doc_id, regexp_replace(regexp_replace(nfc_normalize(text), '[\n\r\t]+', ' ', 'g'), '\s+', ' ', 'g') as t from documents),
 p as (select doc_id, string_split_regex(t, '[,.]') as p, regexp_extract_all(t, '[,.]') as m from t),
 j as (select doc_id, array_to_string(list_transform(p, lambda x, i: case when i = 1 then x
     when regexp_matches(p[i - 1], '\d$') and regexp_matches(x, '^\d{3}') then x else m[i - 1] || x end), '') as t from p)
select doc_id, regexp_replace(regexp_replace(lower(t), '\b(mg/dl|mg/dL)\b', 'mg/dL', 'g'), '\b(ng)/(ml|mL)\b', 'ng/mL', 'g') as text from j
""")
def normalised_documents(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.normalise(F.col("text")).alias("text"))


# P6-P8 on notes ---------------------------------------------------------------
def _abbrev_sql(x: str) -> str:
    for abbr, full in tx.ABBREVIATIONS:
        x = f"regexp_replace({x}, '\\b{abbr}\\b', '{full}', 'gi')"
    return x


def _phi_sql(x: str) -> str:
    for pat in tx.PHI_PATTERNS:
        x = f"regexp_replace({x}, '{pat}', '{tx.REDACTED}', 'g')"
    return x


def _phi_hits_sql(x: str) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({x}, '{p}'))" for p in tx.PHI_PATTERNS) + ")::BIGINT"


def _sci_sql(x: str) -> str:
    for pat, rep in tx.SCIENTIFIC_UNITS:
        x = f"regexp_replace({x}, '{pat}', '{rep}', 'g')"
    return f"regexp_replace({x}, '(\\d+)\\s*\\^\\s*(\\d+)', '\\1^\\2', 'g')"


@register("notes_abbreviations", f"""
select note_id, {_abbrev_sql('text')} as text from {NOTES_SQL}
""")
def notes_abbreviations(spark, sf):
    return notes(spark, sf).select("note_id", tx.expand_abbreviations(F.col("text")).alias("text"))


@register("notes_redacted", f"""
select note_id, {_phi_sql(_abbrev_sql('text'))} as text, {_phi_hits_sql(_abbrev_sql('text'))} as phi_hits
from {NOTES_SQL}
""")
def notes_redacted(spark, sf):
    n = notes(spark, sf).withColumn("expanded", tx.expand_abbreviations(F.col("text")))
    return n.select("note_id", tx.redact_phi(F.col("expanded")).alias("text"),
                    tx.phi_hits(F.col("expanded")).alias("phi_hits"))


@register("notes_scientific", f"""
select note_id, {_sci_sql('text')} as text from {NOTES_SQL}
""")
def notes_scientific(spark, sf):
    return notes(spark, sf).select("note_id", tx.scientific_clean(F.col("text")).alias("text"))


# P9 ---------------------------------------------------------------------------
@register("general_clean", f"""
select doc_id, {clean_sql('text')} as text from documents
""")
def general_clean(spark, sf):
    return _clean_docs(spark, sf).select("doc_id", "text")


# Pipeline chosen per dataset -----------------------------------------
NOTE_PIPELINES = {"AUTOMOBILE": "medical", "BUILDING": "scientific",
                  "FURNITURE": "general", "HOUSEHOLD": "legal"}


def _choice_sql() -> str:
    sql = "case"
    for ds, name in NOTE_PIPELINES.items():
        if name == "medical":
            sql += f" when dataset = '{ds}' then {_phi_sql(_abbrev_sql('text'))}"
        elif name == "scientific":
            sql += f" when dataset = '{ds}' then {_sci_sql('text')}"
    return sql + f" else {clean_sql('text')} end"


@register("notes_pipeline_choice", f"""
select note_id, dataset, {_choice_sql()} as text from {NOTES_SQL}
""")
def notes_pipeline_choice(spark, sf):
    n = notes(spark, sf)
    pipe = tx.pipeline_for_dataset(F.col("dataset"), NOTE_PIPELINES)
    return n.select("note_id", "dataset", tx.apply_pipeline(F.col("text"), pipe).alias("text"))


# S5 ---------------------------------------------------------------------------
@register("document_lines", f"""
with l as (select doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) as line,
                  generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) - 1 as line_no
           from documents)
select doc_id, line_no::BIGINT as line_no, {strip_sql('line')} as line from l
where {strip_sql('line')} <> ''
""")
def document_lines(spark, sf):
    return records.line_corpus(_docs(spark, sf), key="doc_id")


# S10 --------------------------------------------------------------------------
@register("safe_page_names", """
select page_id, 'file_' || substr(md5(url), 1, 8) ||
  regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1) as safe_name
from pages
""")
def safe_page_names(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.safe_file_name(F.col("url")).alias("safe_name"))


# Routing by mean word count per dataset -------------------------------
@register("encoding_route", f"""
select source, round(avg({word_count_sql('text')}), 6) as mean_words,
  case when avg({word_count_sql('text')}) < 512 then 'bi' else 'auto' end as route
from documents group by source
""")
def encoding_route(spark, sf):
    from ..operators import qa
    return qa.encoding_route(_docs(spark, sf), group_col="source")


# Several datasets with stats -------------------------------------------
@register("corpus_stats", """
with u as (
  select 'documents' as dataset, text from documents
  union all select 'conversations', text from conversations
  union all select 'benchmark', text from benchmark
)
select dataset, count(*)::BIGINT as n_samples, sum(length(text))::BIGINT as n_chars
from u where text is not null and regexp_matches(text, '\\S') group by dataset
""")
def corpus_stats(spark, sf):
    descriptors = [
        {"name": "documents", "type": "huggingface", "config": {"path": f"{sf}/documents.parquet"}},
        {"name": "conversations", "type": "huggingface", "config": {"path": f"{sf}/conversations.parquet"}},
        {"name": "benchmark", "type": "huggingface", "config": {"path": f"{sf}/benchmark.parquet"}},
    ]
    corpus = records.load_corpora(spark, descriptors)
    return records.corpus_stats(corpus).select("dataset", "n_samples", "n_chars")
