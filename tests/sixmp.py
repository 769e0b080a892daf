"""6-MP leukaemia remission trial (Freireich et al. 1963), a standard
public survival dataset: (time, event, group)."""

TREATED = [(6, 1), (6, 1), (6, 1), (6, 0), (7, 1), (9, 0), (10, 1), (10, 0), (11, 0), (13, 1),
           (16, 1), (17, 0), (19, 0), (20, 0), (22, 1), (23, 1), (25, 0), (32, 0), (32, 0),
           (34, 0), (35, 0)]
CONTROL = [1, 1, 2, 2, 3, 4, 4, 5, 5, 8, 8, 8, 8, 11, 11, 12, 12, 15, 17, 22, 23]

ROWS = ([(i, t, e, "treated") for i, (t, e) in enumerate(TREATED)]
        + [(100 + i, t, 1, "control") for i, t in enumerate(CONTROL)])


def frame(spark):
    return spark.createDataFrame(ROWS, "id bigint, time bigint, event bigint, arm string")
