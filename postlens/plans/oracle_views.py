"""The stand-in views of ``views.py`` written as DuckDB SQL, for the oracles.

Each oracle query starts with ``with_views(...)``, which emits a WITH clause
holding the requested views and the views they depend on, in dependency order.
"""

from __future__ import annotations

from postlens.plans.views import DISCLOSURE_PHRASES, GENDER_CSV_HEADER, GENDER_VALUES

WORDS_RE2 = r"[^\s\x1c-\x1f]+"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]"


def words_sql(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{WORDS_RE2}')"


def wc_sql(expr: str) -> str:
    return f"CAST(len({words_sql(f"coalesce({expr}, 'nan')")}) AS BIGINT)"


VIEWS: dict[str, tuple[list[str], str]] = {
    "v_posts": ([], """
        SELECT CAST(conv_id AS VARCHAR) AS user_id, CAST(turn AS VARCHAR) AS post_id,
               CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS TID,
               CAST(turn AS BIGINT) AS created_utc,
               CASE WHEN role = 'user' THEN 'post' ELSE 'comment' END AS type,
               text, 'en' AS language, conv_id, turn
        FROM conversations"""),
    "v_meta": ([], f"""
        SELECT CAST(conv_id AS VARCHAR) AS user_id, CAST(turn AS VARCHAR) AS post_id,
               CAST(turn AS BIGINT) AS created_utc, {wc_sql('text')} AS word_count
        FROM conversations WHERE role <> 'system'"""),
    "v_doc_posts": ([], """
        SELECT source AS user_id, CAST(doc_id AS VARCHAR) AS post_id,
               source || '_' || CAST(doc_id AS VARCHAR) AS TID, text, lang AS language, doc_id
        FROM documents"""),
    "v_disclosure_posts": (["v_posts"], f"""
        SELECT user_id, post_id, TID, created_utc, type,
               text || ' ' || ({sql_list(DISCLOSURE_PHRASES)})[CAST((conv_id * 7 + turn) % {len(DISCLOSURE_PHRASES)} AS INTEGER) + 1] AS text,
               language, conv_id, turn
        FROM v_posts"""),
    "v_sent": ([], """
        SELECT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS TID,
               l_suppkey AS sid, l_returnflag AS label, 'corpus' AS source, 'none' AS model,
               CAST(l_linenumber AS DOUBLE) AS wid, l_quantity, l_extendedprice, l_discount, l_tax
        FROM lineitem"""),
    "v_sent_auth": ([], """
        SELECT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS TID,
               l_suppkey AS sid, l_returnflag AS label, 'corpus' AS source, 'none' AS model,
               CAST(l_linenumber AS DOUBLE) AS wid, l_quantity, l_extendedprice, l_discount, l_tax
        FROM lineitem WHERE l_linestatus = 'F'"""),
    "v_sent_syn": ([], """
        SELECT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS TID,
               l_suppkey AS sid, l_returnflag AS label, 'corpus' AS source, 'none' AS model,
               CAST(l_linenumber AS DOUBLE) AS wid, l_quantity, l_extendedprice, l_discount, l_tax
        FROM lineitem WHERE l_linestatus = 'O'"""),
    "v_emb": ([], """
        SELECT CAST(vec_id AS VARCHAR) AS TID, vec_id, embedding, CAST(label AS BIGINT) AS cluster FROM embeddings"""),
    "v_personas": ([], """
        SELECT e.vec_id AS persona_id, e.embedding, d.text AS persona_text
        FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id"""),
    "v_member_texts": (["v_personas"], """
        SELECT persona_id AS vec_id, coalesce(persona_text, '') AS text FROM v_personas"""),
    "v_generated": ([], """
        SELECT conv_id AS prompt_id, turn + 1 AS attempt,
          CASE (conv_id * 3 + turn) % 11
            WHEN 0 THEN CASE WHEN conv_id % 2 = 0 THEN '"' || text || '"' ELSE '  ''' || text || ''' ' END
            WHEN 1 THEN 'Here is my comment: ' || text
            WHEN 2 THEN 'AI ' || text
            WHEN 3 THEN text || ' Hope this helps'
            WHEN 4 THEN ''
            WHEN 5 THEN '[No valid comment generated]'
            WHEN 6 THEN '[No valid comment]'
            WHEN 7 THEN '[Error: model timed out]'
            WHEN 8 THEN 'His take: ' || text
            WHEN 9 THEN text || ' living with bipolar is hard'
            ELSE text END AS text
        FROM conversations"""),
    "v_scores": ([], """
        SELECT l.doc_id, d.source, CAST(l.quality AS BIGINT) AS y,
               (d.n_chars % 1000) / 1000.0 AS score,
               CAST(((d.n_chars % 1000) / 1000.0) >= 0.5 AS BIGINT) AS pred
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""),
    "v_gender_csv": ([], f"""
        SELECT c_custkey AS "Row ID", c_name AS " Name",
               ({sql_list(GENDER_VALUES)})[CAST(c_custkey % {len(GENDER_VALUES)} AS INTEGER) + 1] AS "{GENDER_CSV_HEADER}",
               c_mktsegment AS "Market  Segment"
        FROM customer"""),
}


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        deps, _ = VIEWS[n] if n in VIEWS else (EXTRA[n][0], None)
        for d in deps:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


EXTRA: dict[str, tuple[list[str], str]] = {}


def define(name: str, deps: list[str], sql: str) -> None:
    """Register a derived CTE (for example user means) usable by several oracles."""
    EXTRA[name] = (deps, sql)


def with_views(*names: str) -> str:
    parts = []
    for n in _order(names):
        sql = VIEWS[n][1] if n in VIEWS else EXTRA[n][1]
        parts.append(f"{n} AS ({sql}\n)")
    return "WITH " + ",\n".join(parts) + "\n"
