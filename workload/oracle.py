"""DuckDB statements that give the results of the registered queries.

They state each result over the whole tables with joins, unnest and windows,
without the blocks, broadcasts and kernels of the Spark plans.
"""

from __future__ import annotations

from folioseek.config import DEFAULT_MODEL, MODELS, ModelSettings
from folioseek.functions.prompts import PARAGRAPH_PREFIX, QUESTION_PREFIX
from folioseek.functions.screening import NON_ANSWER_PHRASES
from folioseek.functions.text import BLANKS
from folioseek.functions.vectors import DEFAULT_DIM
from folioseek.operators.answers import DO_NOT_KNOW, NO_ANSWER


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[ \n\t\r]+'), lambda x: x <> '')"


def with_ctes(names: str, body: str) -> str:
    """A statement that starts with shared CTEs; a body with a comma in front adds its own."""
    return "WITH " + ",\n".join(f"{name} AS ({CTES[name]})" for name in names.split()) + "\n" + body


def chunks(size: int, overlap: int, source: str = "documents") -> str:
    step = size - overlap
    return f"""
SELECT doc_id, source, (i // {step})::INTEGER AS chunk_no,
       ((len(t) + {step - 1}) // {step})::INTEGER AS num_chunks,
       array_to_string(t[i + 1 : i + {size}], ' ') AS text
FROM (SELECT doc_id, source, t, unnest(range(0, len(t), {step})) AS i
      FROM (SELECT doc_id, source, {tokens('text')} AS t FROM {source}))"""


def clean(content: str) -> str:
    bare = f"replace(replace(replace({content}, ':selected:', ''), ':unselected:', ''), chr(10), '')"
    return f"trim({bare}, {quoted(BLANKS)})"


def page_text(after: str) -> str:
    """The text behind an opening tag, up to where a block begins or ends, without the tags in it."""
    block = r"</?(p|article|body|footer|div|nav|h[1-6]|ul|table)\b"
    return rf"regexp_replace(replace(regexp_split_to_array({after}, '{block}')[1], '<br>', ' '), '<[^>]*>', '', 'g')"


def unmarked(content: str) -> str:
    return f"replace(replace({content}, ':selected:', ''), ':unselected:', '')"


def good(answer: str) -> str:
    says_nothing = " OR ".join(f"contains(lower({answer}), {quoted(p)})" for p in NON_ANSWER_PHRASES)
    return f"coalesce({answer} <> '' AND NOT ends_with({answer}, '?') AND NOT ({says_nothing}), false)"


def rendered(template: str) -> str:
    """The template as a concatenation; it names each place once."""
    before, rest = template.split("{context}")
    between, after = rest.split("{question}")
    return f"concat({quoted(before)}, context, {quoted(between)}, question, {quoted(after)})"


def paragraph_list(value: str, where: str = "true") -> str:
    return (
        f"string_agg({quoted(PARAGRAPH_PREFIX)} || {value}, '' ORDER BY rank) FILTER (WHERE {where})"
    )


HEADING = """last_value(CASE WHEN kind = 'columnHeader' THEN content END IGNORE NULLS) OVER (
  PARTITION BY {scope}, column_index ORDER BY table_idx, cell_idx
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

LINE = """CASE
  WHEN kind <> 'content'
    THEN concat('Cell[', row_index, '][', column_index, '] as ', kind, ' has text ''', content, '''')
  WHEN heading IS NULL
    THEN concat('Cell[', row_index, '][', column_index, '] has text ''', content, '''')
  ELSE concat('Cell[', row_index, '][', column_index, '] with column heading ''', heading,
              ''' has text ''', content, '''')
END"""


def headed(scope: str) -> str:
    return f"""
SELECT doc_id, table_idx, cell_idx, row_index, column_index, kind, content, {HEADING.format(scope=scope)} AS heading
FROM (SELECT * REPLACE ({unmarked('content')} AS content) FROM cells)"""


CTES = {
    "lines": """
SELECT doc_id, unnest(range(0, len(l)))::INTEGER AS pos, unnest(l) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "placed": "SELECT doc_id, pos, line, (pos // 20)::INTEGER AS table_idx, (pos % 20)::INTEGER AS r FROM lines",
    "cells": """
SELECT doc_id, table_idx, r AS row_index, r * 3 AS cell_idx, 0 AS column_index, 'rowHeader' AS kind,
       pos::VARCHAR AS content FROM placed
UNION ALL
SELECT doc_id, table_idx, r, r * 3 + 1, 1,
       CASE WHEN r = 0 AND table_idx % 2 = 0 THEN 'columnHeader' ELSE 'content' END,
       CASE WHEN pos % 3 = 0 THEN ':selected: ' || line || ' ' ELSE line END FROM placed
UNION ALL
SELECT doc_id, table_idx, r, r * 3 + 2, 2, 'content', length(line)::VARCHAR FROM placed""",
    "paragraphs": """
SELECT doc_id, pos AS para_idx,
       CASE r WHEN 18 THEN 'pageFooter' WHEN 19 THEN 'pageNumber' END AS role,
       CASE WHEN pos % 2 = 0 THEN line || ' :unselected:' ELSE 'Note: ' || line || chr(10) END AS content
FROM placed""",
    "headed": headed("doc_id"),
    "cell_texts": f"SELECT DISTINCT doc_id, {clean('content')} AS clean FROM cells",
    "printed": f"""
SELECT doc_id, 0 AS section, 0 AS table_idx, para_idx AS place, clean AS line
FROM (SELECT doc_id, para_idx, role, {clean('content')} AS clean FROM paragraphs)
ANTI JOIN cell_texts USING (doc_id, clean)
WHERE coalesce(role, '') NOT IN ('pageNumber', 'pageFooter')
UNION ALL
SELECT DISTINCT doc_id, 1, table_idx, -1, 'Below is a Table:' FROM cells
UNION ALL
SELECT doc_id, 1, table_idx, cell_idx, {LINE} FROM headed""",
    "flattened": """
SELECT doc_id, string_agg(line || chr(10), '' ORDER BY section, table_idx, place) AS full_text
FROM printed GROUP BY doc_id""",
    "chunks": chunks(512, 50),
    # CRC-32, bit by bit for the 256 bytes, then byte by byte for each token.
    "crc_bytes": """
SELECT list(c ORDER BY i) AS crc_table
FROM (SELECT i, list_reduce([i] || range(8), lambda c, bit:
             CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))""",
    "words": f"""
SELECT DISTINCT token FROM (SELECT token FROM chunk_tokens UNION ALL SELECT token FROM question_tokens)""",
    "word_bytes": """
SELECT token, [('0x' || substr(hex(token), 2 * i + 1, 2))::BIGINT for i in range(strlen(token))] AS bytes FROM words""",
    "buckets": f"""
SELECT token, (xor(list_reduce([4294967295] || bytes, lambda c, b:
                   xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) % {DEFAULT_DIM})::INTEGER AS bucket
FROM word_bytes, crc_bytes""",
    "chunk_tokens": "SELECT doc_id, chunk_no, unnest(string_split(text, ' ')) AS token FROM chunks",
    "chunk_vectors": """
SELECT doc_id, chunk_no, bucket, count(*)::INTEGER AS tf
FROM chunk_tokens JOIN buckets USING (token) GROUP BY ALL""",
    "questions": "SELECT item_id AS question_id, text AS question FROM benchmark",
    "question_tokens": f"""
SELECT question_id, unnest({tokens('question')}) AS token FROM questions""",
    "question_vectors": """
SELECT question_id, bucket, count(*) AS tf FROM question_tokens JOIN buckets USING (token) GROUP BY ALL""",
    "num": "SELECT count(*) AS n FROM chunks",
    "dfs": "SELECT bucket, count(*) AS df FROM chunk_vectors GROUP BY bucket",
    "question_weights": """
SELECT question_id, bucket, tf, length(bin(n // coalesce(df, 1))) AS w
FROM question_vectors LEFT JOIN dfs USING (bucket), num""",
    "question_norms": "SELECT question_id, sum(tf * tf * w * w) AS nq FROM question_weights GROUP BY question_id",
    "chunk_norms": """
SELECT doc_id, chunk_no, sum(tf * tf * length(bin(n // df)) * length(bin(n // df))) AS nd
FROM chunk_vectors JOIN dfs USING (bucket), num GROUP BY doc_id, chunk_no""",
    "dots": """
SELECT question_id, doc_id, chunk_no, sum(q.tf * c.tf * w * w) AS dot
FROM question_weights q JOIN chunk_vectors c USING (bucket) GROUP BY question_id, doc_id, chunk_no""",
    "scored": """
SELECT question_id, doc_id, chunk_no, dot::DOUBLE / sqrt(nq::DOUBLE * nd::DOUBLE) AS score
FROM dots JOIN question_norms USING (question_id) JOIN chunk_norms USING (doc_id, chunk_no)""",
    "ranked": """
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, chunk_no)::INTEGER AS rank
FROM scored QUALIFY rank <= 10""",
    "hits": "SELECT question_id, rank, doc_id, chunk_no, source, text FROM ranked JOIN chunks USING (doc_id, chunk_no)",
    "contexts": f"""
SELECT question_id, ((rank - 1) // 3)::INTEGER AS group_no, {paragraph_list('text')} AS context,
       arg_max(source, rank) AS source
FROM hits GROUP BY ALL""",
    "asked": "SELECT * FROM contexts JOIN questions USING (question_id)",
    "context_sentences": r"""
SELECT question_id, group_no, list_filter(list_transform(regexp_split_to_array(context, '[.!?\n]+'),
         lambda s: trim(s, ' ')), lambda s: s <> '' AND s <> 'Paragraph:') AS sentences FROM contexts""",
    "sentence_rows": """
SELECT question_id, group_no, unnest(sentences) AS sentence, unnest(range(0, len(sentences))) AS place
FROM context_sentences""",
    "sentence_scores": f"""
SELECT question_id, group_no, sentence, place,
       len(list_intersect(list_distinct({tokens('lower(sentence)')}), list_distinct({tokens('lower(question)')}))) AS shared
FROM sentence_rows JOIN questions USING (question_id)""",
    "best_sentences": """
SELECT question_id, group_no, shared, sentence FROM sentence_scores
QUALIFY row_number() OVER (PARTITION BY question_id, group_no ORDER BY shared DESC, place) = 1""",
    "candidates": f"""
SELECT question_id, group_no,
       CASE WHEN coalesce(shared, 0) > 0 THEN sentence ELSE {quoted(DO_NOT_KNOW)} END AS answer, source,
       concat('{{"shared_terms":', coalesce(shared, 0), '}}') AS output_metadata, context AS vector_doc
FROM contexts LEFT JOIN best_sentences USING (question_id, group_no)""",
    "first_good": f"""
SELECT * FROM candidates WHERE {good('answer')}
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY group_no) = 1""",
    "answers": f"""
SELECT question_id, question, coalesce(answer, {quoted(NO_ANSWER)}) AS answer, coalesce(source, 'NA') AS source,
       coalesce(output_metadata, 'NA') AS output_metadata, coalesce(vector_doc, 'NA') AS vector_doc
FROM questions LEFT JOIN first_good USING (question_id)""",
}

LAYOUT = "lines placed cells"
FLATTENED = f"{LAYOUT} paragraphs headed cell_texts printed flattened"
LAYOUT_DOCUMENTS = "(SELECT doc_id, NULL AS source, full_text AS text FROM flattened)"
# Pages of 20 lines, and documents whose lines are followed by a table of their lengths.
PAGE_DOCUMENTS = """(
  SELECT 'file-' || doc_id || '#page=' || (pos // 20) AS doc_id, 'file-' || doc_id AS source, (pos // 20)::INTEGER AS page,
         string_agg(line, chr(10) ORDER BY pos) AS text
  FROM (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) GROUP BY doc_id, pos // 20)"""
LINE_DOCUMENTS = f"""(
  SELECT 'file-' || doc_id AS doc_id, 'file-' || doc_id AS source,
         list_aggregate(list_filter(list_transform(l, lambda x: {clean('x')}),
           lambda x: NOT list_contains(list_transform(l, lambda y: length(y)::VARCHAR), x)) || ['Below is a Table:']
           || list_transform(range(0, len(l)), lambda i: concat('Cell[', i, '][0] has text ''', length(l[i + 1]), '''')),
           'string_agg', chr(10)) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
VECTORS = "chunks chunk_tokens questions question_tokens words word_bytes crc_bytes buckets chunk_vectors"
HITS = (
    f"{VECTORS} question_vectors num dfs question_weights question_norms "
    "chunk_norms dots scored ranked hits"
)
CANDIDATES = f"{HITS} contexts context_sentences sentence_rows sentence_scores best_sentences candidates"
ANSWERS = f"{CANDIDATES} first_good answers"

INDEX_ROWS = with_ctes(
    VECTORS,
    """
SELECT doc_id, chunk_no, any_value(num_chunks) AS num_chunks, any_value(source) AS source,
       any_value(text) AS text, count(*)::INTEGER AS num_buckets, sum(tf)::INTEGER AS num_tokens
FROM chunk_vectors JOIN chunks USING (doc_id, chunk_no) GROUP BY doc_id, chunk_no""",
)
ANSWER_ROWS = with_ctes(
    ANSWERS, "SELECT question_id, question, answer, source, output_metadata, vector_doc FROM answers"
)


def model_rows(select: str, models: list[ModelSettings]) -> str:
    return "\nUNION ALL\n".join(select.format_map(_Model(m)) for m in models)


class _Model(dict):
    def __init__(self, model: ModelSettings) -> None:
        super().__init__(
            model_id=quoted(model.model_id),
            embedding_model=quoted(model.embedding_model),
            template=quoted(model.template),
            prompt=rendered(model.template),
        )


def parameter_statement() -> str:
    rows = []
    for model in MODELS.values():
        settings = {"model_id": model.model_id, "embedding_model": model.embedding_model, "dataset": "benchmark"}
        for key, value in {**settings, **model.options}.items():
            rows.append(f"SELECT 'first run' AS run_id, {quoted(model.model_id)} AS run_name, {quoted(key)} AS key, {quoted(value)} AS value")
        rows.append(f"SELECT 'first run', {quoted(model.model_id)}, 'dataset_rows', count(*)::VARCHAR FROM benchmark")
        rows.append(
            f"SELECT 'first run', {quoted(model.model_id)}, 'dataset_digest', "
            "sum(('0x' || substr(md5(text), 1, 8))::BIGINT)::VARCHAR FROM benchmark"
        )
    return "\nUNION ALL\n".join(rows)


def evaluated(model_id: str, dim: int) -> str:
    """What the stand-in of a model answers, with contexts from vectors of ``dim`` buckets."""
    model = MODELS[model_id]
    statement = with_ctes(
        f"{HITS} contexts asked",
        f"""
, prompts AS (
  SELECT question_id, group_no, source, length({rendered(model.template)}) AS n FROM asked),
first_even AS (
  SELECT * FROM prompts WHERE n % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY group_no) = 1)
SELECT 'first run' AS run_id, {quoted(model_id)} AS run_name, question AS questions,
       coalesce(n || ' characters at {model.options["temperature"]}', {quoted(NO_ANSWER)}) AS outputs,
       coalesce(source, 'NA') AS source, {quoted(model.template)} AS template
FROM questions LEFT JOIN first_even USING (question_id)""".lstrip(),
    )
    return statement.replace(f"% {DEFAULT_DIM})", f"% {dim})")


ORACLE_SQL: dict[str, str] = {
    "page_split": """
SELECT doc_id, source, (pos // 20)::INTEGER AS page, string_agg(line, chr(10) ORDER BY pos) AS full_text
FROM (SELECT doc_id, source, unnest(range(0, len(l))) AS pos, unnest(l) AS line
      FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))
GROUP BY ALL""",
    "page_decode": """
SELECT unnest(pages) AS full_text, doc_id::VARCHAR AS source, unnest(range(0, len(pages)))::INTEGER AS page
FROM (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents)""",
    "corpus_table": "SELECT doc_id, source, text AS full_text FROM documents",
    "corpus_project": "SELECT text AS full_text, source FROM documents",
    "corpus_count": "SELECT count(*) AS num_rows FROM documents",
    "longest_document": """
SELECT doc_id, length(text) AS n_chars, text AS full_text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1""",
    "chunk_documents": chunks(512, 50),
    "chunk_documents_small": chunks(64, 8),
    "chunk_longest": chunks(
        2000, 300, "(SELECT * FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1) longest"
    ),
    "chunk_user_tokens": """
SELECT doc_id, source, (i // 462)::INTEGER AS chunk_no, ((length(text) + 461) // 462)::INTEGER AS num_chunks,
       substring(text, i + 1, 512) AS text
FROM (SELECT doc_id, source, text, unnest(range(0, length(text), 462)) AS i FROM documents)""",
    "chunk_metadata": with_ctes(
        "chunks", "SELECT doc_id, chunk_no, concat('{\"source\":\"', source, '\"}') AS metadata FROM chunks"
    ),
    "layout_clean": with_ctes(
        LAYOUT, f"SELECT doc_id, table_idx, cell_idx, {clean('content')} AS clean FROM cells"
    ),
    "layout_paragraphs": rf"""
WITH found AS (
  SELECT page_id AS doc_id,
         list_concat(list_transform(string_split(html, '<p>')[2:],
                                    lambda t: {{'role': NULL::VARCHAR, 'content': {page_text('t')}}}),
                     list_transform(string_split(html, '<footer>')[2:],
                                    lambda t: {{'role': 'pageFooter', 'content': {page_text('t')}}})) AS entries FROM pages),
paragraphs AS (
  SELECT doc_id, unnest(range(0, len(entries)))::INTEGER AS para_idx, unnest(entries) AS entry FROM found),
cleaned AS (
  SELECT doc_id, para_idx, entry.role AS role, {clean('entry.content')} AS clean FROM paragraphs),
cell_texts AS (
  SELECT DISTINCT doc_id, {clean('content')} AS clean
  FROM (SELECT page_id AS doc_id,
               unnest(list_transform(string_split(html, '<a ')[2:], lambda t:
                 regexp_replace(split_part(substr(t, strpos(t, '>') + 1), '</a>', 1), '<[^>]*>', '', 'g'))) AS content
        FROM pages))
SELECT doc_id, para_idx, role, clean FROM cleaned ANTI JOIN cell_texts USING (doc_id, clean)
WHERE coalesce(role, '') NOT IN ('pageNumber', 'pageFooter')""",
    "layout_headers": with_ctes(
        f"{LAYOUT} headed", "SELECT doc_id, table_idx, cell_idx, column_index, heading FROM headed"
    ),
    "layout_cells": with_ctes(
        LAYOUT,
        f"SELECT doc_id, table_idx, cell_idx, {LINE} AS line FROM ({headed('doc_id, table_idx')})",
    ),
    "layout_flatten": with_ctes(FLATTENED, "SELECT doc_id, full_text FROM flattened"),
    "layout_chunks": with_ctes(
        FLATTENED, f"SELECT doc_id, chunk_no, num_chunks, text FROM ({chunks(512, 50, LAYOUT_DOCUMENTS)})"
    ),
    "ingest_pages": f"""
SELECT d.doc_id, d.source, page, chunk_no, num_chunks, c.text
FROM ({chunks(512, 50, PAGE_DOCUMENTS)}) c JOIN {PAGE_DOCUMENTS} d USING (doc_id)""",
    "ingest_layout": f"""
SELECT doc_id, source, NULL::INTEGER AS page, chunk_no, num_chunks, text
FROM ({chunks(512, 50, LINE_DOCUMENTS)})""",
    "embed_hashed": with_ctes(VECTORS, "SELECT doc_id, chunk_no, bucket, tf FROM chunk_vectors"),
    "index_build": INDEX_ROWS,
    "question_prefix": f"SELECT item_id AS question_id, {quoted(QUESTION_PREFIX)} || text AS text FROM benchmark",
    "retrieve_sparse": with_ctes(
        HITS, "SELECT question_id, rank, round(score, 6) AS score, doc_id, chunk_no FROM ranked"
    ),
    "retrieve_with_source": with_ctes(HITS, "SELECT question_id, rank, doc_id, chunk_no, source, text FROM hits"),
    "retrieve_dense": """
WITH means AS (
  SELECT label, pos, round(avg(x::DOUBLE), 6) AS x
  FROM (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings)
  GROUP BY label, pos),
asked AS (SELECT label AS question_id, list(x ORDER BY pos) AS q FROM means GROUP BY label),
pairs AS (
  SELECT question_id, vec_id,
         list_reduce([0::DOUBLE] || list_transform(range(1, len(q) + 1),
               lambda i: (embedding[i]::DOUBLE - q[i]) * (embedding[i]::DOUBLE - q[i])), lambda x, y: x + y) AS exact
  FROM asked, embeddings)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY exact, vec_id)::INTEGER AS rank,
       vec_id, round(exact, 6) AS distance
FROM pairs QUALIFY rank <= 10""",
    "context_groups": with_ctes(
        f"{HITS} contexts", "SELECT question_id, group_no, context, source FROM contexts"
    ),
    "context_running": with_ctes(
        f"{HITS}",
        f"""
SELECT g.question_id, g.group_no, {paragraph_list('h.text')} AS context
FROM (SELECT DISTINCT question_id, ((rank - 1) // 3)::INTEGER AS group_no FROM hits) g
JOIN hits h ON h.question_id = g.question_id AND (h.rank - 1) // 3 <= g.group_no
GROUP BY g.question_id, g.group_no""",
    ),
    "context_top3": with_ctes(
        HITS, f"SELECT question_id, {paragraph_list('text', 'rank <= 3')} AS context FROM hits GROUP BY question_id"
    ),
    "prompt_render": with_ctes(
        f"{HITS} contexts asked",
        f"SELECT question_id, group_no, {rendered(MODELS[DEFAULT_MODEL].template)} AS prompt FROM asked",
    ),
    "prompt_by_model": with_ctes(
        f"{HITS} contexts asked",
        model_rows(
            "SELECT question_id, group_no, {model_id} AS model_id, {prompt} AS prompt FROM asked",
            list(MODELS.values()),
        ),
    ),
    "answer_extractive": with_ctes(
        CANDIDATES,
        "SELECT question_id, group_no, answer, source, output_metadata, vector_doc FROM candidates",
    ),
    "answer_screen": f"SELECT conv_id, turn, {good('text')} AS good FROM conversations",
    "first_good_answer": with_ctes(
        ANSWERS, "SELECT question_id, answer, source, output_metadata, vector_doc FROM answers"
    ),
    "qa_batch": ANSWER_ROWS,
    "qa_user_model": with_ctes(
        f"{HITS} contexts asked",
        f"""
, prompts AS (
  SELECT question_id, group_no, source, context, length({rendered(MODELS[DEFAULT_MODEL].template)}) AS n FROM asked),
first_even AS (
  SELECT * FROM prompts WHERE n % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY group_no) = 1)
SELECT question_id, question, coalesce(n || ' characters', {quoted(NO_ANSWER)}) AS answer,
       coalesce(source, 'NA') AS source, coalesce(context, 'NA') AS vector_doc
FROM questions LEFT JOIN first_even USING (question_id)""".lstrip(),
    ),
    "qa_busy_model": with_ctes(
        f"{HITS} contexts asked",
        f"""
, prompts AS (
  SELECT question_id, group_no, length({rendered(MODELS[DEFAULT_MODEL].template)}) AS n FROM asked),
first_even AS (
  SELECT * FROM prompts WHERE n % 2 = 0 AND n % 3 <> 0
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY group_no) = 1),
busy AS (
  SELECT DISTINCT p.question_id FROM prompts p LEFT JOIN first_even f ON f.question_id = p.question_id
  WHERE p.n % 3 = 0 AND p.group_no < coalesce(f.group_no, 1000000))
SELECT question_id, coalesce(n || ' characters', {quoted(NO_ANSWER)}) AS answer,
       CASE WHEN b.question_id IS NOT NULL THEN 'no answer within 0.05 seconds' END AS error
FROM questions LEFT JOIN first_even USING (question_id) LEFT JOIN busy b USING (question_id)""".lstrip(),
    ),
    "answer_view": with_ctes(ANSWERS, "SELECT question_id, question, answer, vector_doc, source FROM answers"),
    "chat_history": """
SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""",
    "eval_questions": "SELECT item_id AS question_id, text AS question FROM benchmark",
    "eval_log": with_ctes(
        ANSWERS,
        model_rows(
            "SELECT 'first run' AS run_id, {model_id} AS run_name, question AS questions, answer AS outputs, source, "
            "{template} AS template FROM answers",
            list(MODELS.values()),
        ),
    ),
    "eval_models": "\nUNION ALL\n".join(f"SELECT * FROM ({evaluated(*run)})" for run in (("openai", 4096), ("Llama-2-13b-chat-hf", DEFAULT_DIM))),
    "run_params": parameter_statement(),
    "stream_index": INDEX_ROWS,
    "stream_answers": ANSWER_ROWS,
}
