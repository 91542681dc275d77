from trackloom.operators import tracks


def test_places_exactly_as_far_as_the_radius_are_within_it(spark):
    # the mean of these frames is 15.25, so the first place is 15.25 * 0.02 = 0.305 away from the centre
    frames = [0, 10, 12, 14, 18, 20, 22, 26]
    rows = [("s", f, t, 0.6 * t + 0.02 * f, 2.0 * (t % 5)) for t in range(60) for f in frames]
    found = tracks.static_flag(spark.createDataFrame(rows, "seq_name string, frame_idx int, track_id int, cx double, cy double"), radius=0.305).filter("frame_idx = 26")
    assert {r["track_id"] for r in found.filter("is_static").collect()} == set(range(60))
    near = tracks.static_flag(spark.createDataFrame(rows, "seq_name string, frame_idx int, track_id int, cx double, cy double"), radius=0.30498).filter("is_static and n = 8")
    assert near.count() == 0
