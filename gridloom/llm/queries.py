"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, embeddings, html, licenses, minhash, packing, secrets, toxicity, urls

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_embedding_dedup": embeddings.op2_embedding_dedup,
    "op3_html_extract": html.op3_html_extract,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_chat_format": chat.op5_chat_format,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_minhash_dedup": minhash.op7_minhash_dedup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_url_filter": urls.op9_url_filter,
    "op10_pack": packing.op10_pack,
}

SQL = {**chat.SQL, **urls.SQL}
