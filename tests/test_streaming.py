from helpers import SF
from helpers import plain

from vicinal.plans.vector_queries import knn_vote_score, stream_score


def test_stream_gives_what_the_batch_gives(spark):
    rows = lambda df: sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert rows(stream_score(spark, SF)) == rows(knn_vote_score(spark, SF))
