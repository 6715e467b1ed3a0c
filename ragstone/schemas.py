"""The relations that operators pass on."""

from __future__ import annotations

CORPUS = "id string, title string, text string"
QUERIES = "id string, text string"
QRELS = "query_id string, corpus_id string, score int"
RUN = "query_id string, corpus_id string, score double"
CHUNKS = "chunk_id string, doc_id string, chunk_index int, total_chunks int, text string, is_table boolean"
VECTORS = "id string, embedding array<float>"
MESSAGES = "query_id string, messages array<struct<role:string,content:string>>"
ANSWERS = "query_id string, answer string"
METRICS = "metric string, k int, value double"
#: on disk
CORPUS_FILE = "_id string, title string, text string, metadata map<string,string>"
QUERIES_FILE = "_id string, title string, text string"
CHUNKS_FILE = "_id string, original_id string, text string, chunk_index int, total_chunks int, metadata struct<original_id:string,chunk_index:int,total_chunks:int>"
