"""License phrases whose words are parted by underscores and other signs, against brute force."""

from test_url_license import brute

from kinscribe.llm.license_scan import license_scan


def test_underscores_against_brute_force(spark):
    texts = ["CC_BY_NC", "x cc-by_nc", "__CC BY-NC__", "see _cc__by_nc_ here", "cc_by_nc_sa", "cc by-nc", "xcc by nc", "cc byx nc", "cc by", "ccby nc", "é_cc_by_nc", "écc by nc", "UNDER_THE_MIT_LICENSE", "a\ncc\tby\nnc\n", "apache_license_version_2", "public_domain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels) for x in license_scan(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert {i for i, x in got.items() if x[4] == "cc-by-nc"} == {0, 1, 2, 3, 4, 5, 10, 13}
