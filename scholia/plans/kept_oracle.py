"""SQL of the queries in `kept`."""

from scholia.plans import folds_oracle, oracle, stored_oracle

#: What is kept gives what a plain query over the whole tables gives.
SQL = {
    "streamed_cards": folds_oracle.SQL["fsrs_cards"],
    "indexed_search": oracle.ORACLE_SQL["bm25_search"],
    "indexed_phrases": folds_oracle.SQL["phrase_scan"],
    "adapter_select": stored_oracle.SQL["table_select"],
    "store_merge": oracle.ORACLE_SQL["upsert_latest"],
    "store_update": "SELECT p_partkey, p_brand, CAST(CASE WHEN p_size = 7 THEN 70 ELSE p_size END AS INTEGER) AS p_size, CAST(CASE WHEN p_size = 7 THEN 2 ELSE 1 END AS BIGINT) AS version FROM part WHERE p_brand IS DISTINCT FROM 'Brand#11'",
    "logged_cards": folds_oracle.SQL["fsrs_cards"],
}
