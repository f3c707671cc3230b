"""The queries of the realignment workflow reach the realignment."""

from annulus.plans import catalog, pipelines
from test_queries import DATA


def test_realign_pipeline_realigns_clips(spark, monkeypatch):
    found = []
    inner = pipelines._evidence

    def watched(*args):
        found.append((args, inner(*args)))
        return found[-1][1]

    monkeypatch.setattr(pipelines, "_evidence", watched)
    circles = catalog.queries()["realign_pipeline"](spark, str(DATA)).collect()
    args, (splits, discordants, hits) = found[0]
    assert args[1].count() == args[2].count() and hits.count() > 0 and splits.count() > 0 and discordants.count() > 0
    assert circles and all(r.end > r.start for r in circles)


def test_remapped_reads_give_no_split_evidence(spark):
    reads = catalog.proxy_reads(spark, str(DATA))
    p = pipelines.Params(only_discordants=False, insert_mapq=30, remap_splits=True)
    store = pipelines.Store(spark, "remapped")
    splits, _, hits = pipelines._evidence(store.keep(pipelines.extract(reads), "c"), catalog.proxy_genome(spark, str(DATA)), catalog.proxy_contigs(spark), (280.0, 200.0), p, store)
    assert splits.count() == 0 and hits.count() > 0
    store.close()
