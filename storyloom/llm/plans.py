"""Queries of the training-data operators for language models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import encoding, languages, leaks, lookalikes, mojibake, page_blocks, repeated_lines, survivors, truncation
from storyloom.sources.tables import read_table


def _over(operator, *names: str):
    def query(spark: SparkSession, directory: str) -> DataFrame:
        return operator(*(read_table(spark, directory, name) for name in names))

    return query


QUERIES = {
    "p1_found": _over(truncation.truncated_found, "articles"),
    "p1_share": _over(truncation.truncation_by_source, "articles"),
    "p1_spikes": _over(truncation.spikes_of_columns, "articles"),
    "p1_judged": _over(truncation.judged_values, "articles"),
    "p2_found": _over(languages.languages_found, "articles", "lang_samples"),
    "p2_languages": _over(languages.languages_of, "articles", "lang_samples"),
    "p3_found": _over(lookalikes.lookalikes_found, "articles", "lang_samples"),
    "p3_forms": _over(lookalikes.consistent_forms, "articles", "lang_samples"),
    "p4_found": _over(page_blocks.page_lines_found, "articles", "sources"),
    "p4_texts": _over(page_blocks.main_bodies, "articles", "sources"),
    "p5_found": _over(survivors.survivors_found, "story_members", "articles", "sources"),
    "p5_records": _over(survivors.survivor_records, "story_members", "articles", "sources"),
    "p6_found": _over(repeated_lines.repeated_lines_found, "articles"),
    "p6_bodies": _over(repeated_lines.bodies_without_repeated_lines, "articles", "sources"),
    "p8_ids": _over(encoding.encode_corpus, "documents"),
    "p9_found": _over(leaks.leaks_found, "documents", "eval_items"),
    "p9_tiles": _over(leaks.covered_items, "documents", "eval_items"),
    "p10_found": _over(mojibake.mojibake_found, "documents", "lang_samples"),
    "p10_restored": _over(mojibake.restored_texts, "documents", "lang_samples"),
    "p10_mappings": _over(mojibake.learnt_mappings, "documents", "lang_samples"),
}

_LINES = r"""
bodies as (select distinct source_id, article_id, body from articles where body is not null and source_id is not null and article_id is not null and regexp_replace(body, '[\s\p{Z}\x1c-\x1f\x{85}]+', '', 'g') <> ''),
raw as (select source_id, article_id, unnest(string_split(body, chr(10))) as line, unnest(range(1, len(string_split(body, chr(10))) + 1)) as line_no from bodies),
lines as (select source_id, article_id, line_no, trim(regexp_replace(regexp_replace(lower(line), '[0-9٠-٩]+', '0', 'g'), '[\s\p{Z}\x1c-\x1f\x{85}]+', ' ', 'g')) as k from raw),
totals as (select source_id, count(distinct article_id) as total from bodies group by source_id),
hot as (select source_id, k from (select source_id, k, count(distinct article_id) as n from lines where k <> '' group by source_id, k) join totals using (source_id) where n >= 5 and n >= 0.02 * total)
"""

_WORDS = r"list_transform(regexp_extract_all(lower(regexp_replace(text, '[\x{640}\x{64b}-\x{652}]', '', 'g')), '[\p{L}\p{N}]+'), lambda w: w)"
_WINDOWS = f"""
words as (select 'd' as side, doc_id as id, {_WORDS} as w from documents where text is not null union all select 'i', item_id, {_WORDS} from eval_items where text is not null),
windows as (select distinct side, id, array_to_string(w[i : i + 12], ' ') as g from (select side, id, w, unnest(range(1, len(w) - 11)) as i from words where len(w) >= 13))
"""

SQL = {
    "p9_found": f"with {_WINDOWS} select distinct d.id as doc_id, i.id as item_id from windows d join windows i using (g) where d.side = 'd' and i.side = 'i'",
    "p6_found": f"with {_LINES} select distinct article_id, cast(line_no as integer) as line_no from lines join hot using (source_id, k)",
}
