from bipath.functions.buckets import key_bucket
from bipath.functions.text import confidence_score, fasta_body, is_blank, strip_known_prefix

__all__ = ["confidence_score", "fasta_body", "is_blank", "key_bucket", "strip_known_prefix"]
