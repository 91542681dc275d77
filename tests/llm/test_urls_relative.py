from test_urls import run


def test_relative_targets_all_tags_and_rel_lists(spark):
    pages = [
        ("http://a.com/x/1", '<link rel="canonical" href="/de/7">'),
        ("https://m.net/2", "<link rel='canonical' href='//a.com/de/7'>"),
        ("http://b.com/de/../y/3", '<link href="../../de/8" rel="alternate canonical">'),
        ("http://c.com/fr/q/4", '<meta http-equiv="refresh" content="0; url=5?x">'),
        ("http://n.net/5", '<link rel=canonical href="http://n.net/5"><link rel="canonical" href="http://a.com/de/9">'),
        ("http://o.net/6", '<meta http-equiv="refresh" content="5"><meta http-equiv="refresh" content="0;url=\'http://a.com/de/9\'">'),
        ("http://p.net/7", '<link rel="not-canonical" href="http://a.com/de/9">'),
        ("http://q.net/8", '<link rel="canonical" href="mailto:x">'),
        ("http://d.com/z/9", '<link rel="canonical" href="?a=/de/1">'),
    ]
    got = run(spark, pages)
    assert [got[i][3] for i in range(9)] == ["block", "block", "block", "allow", "block", "block", "allow", "allow", "allow"]
