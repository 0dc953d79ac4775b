"""Crosswalks against all pairs of their dictionaries, on small ones."""

from pyspark.sql import functions as F

from roleloom.functions import text as T
from roleloom.operators import crosswalk as X

SKILLS = ["sql", "mysql", "mysqlserver", "c", "c++", "c#", "go", "golang", "django", "r", "react", "reactnative", "", None, "sql", "aaaa", "aaa", "aaaaaa", "ql", "node"]
TITLES = ["software engineer", "senior software engineer", "engineer software", "network engineer", "data analyst", "analyst data", "a", "", "officer it", "it officer", "java developer", "javascript developer"]


def values(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "value string")


def test_skill_crosswalk_equals_all_pairs(spark):
    mine, wanted = SKILLS[:14], SKILLS[3:]
    got = {(r.mine, r.wanted) for r in X.skill_crosswalk(values(spark, mine), values(spark, wanted)).collect()}

    def match(a, b):
        return bool(a and b) and (a == b or (len(a) >= 3 and a in b) or (len(b) >= 3 and b in a))
    assert got == {(a, b) for a in mine for b in wanted if match(a, b)}
    rows = X.skill_crosswalk(values(spark, mine), values(spark, wanted))
    assert rows.count() == len(got)
    assert X.skill_crosswalk(values(spark, []), values(spark, wanted)).count() == 0


def test_known_values_of_a_list(spark):
    lists = spark.createDataFrame([(1, ["sql", "go"]), (2, []), (3, ["go", "sql"]), (4, None), (5, ["sql", "go"]), (6, ["cobol", None])], "id int, skills array<string>")
    got = {r.id: sorted(r.known) for r in X.with_known(lists, "skills", values(spark, ["mysql", "sql", "golang", "go"])).collect()}
    both = ["go", "mysql", "sql"]
    assert got == {1: both, 2: [], 3: both, 4: [], 5: both, 6: []}


def test_similar_roles_equal_all_pairs(spark):
    jobs = spark.createDataFrame(list(enumerate(TITLES + TITLES[:2] + [None])), "job_id int, title string")
    levels = {"close": 0.6, "near": 0.4}
    got = {r.job_id: (set(r.close), set(r.near)) for r in X.with_similar_roles(jobs, "title", values(spark, TITLES), levels).collect()}
    pairs = jobs.join(values(spark, TITLES).distinct()).withColumn("s", T.title_similarity_normalized(F.col("value"), F.col("title"))).collect()
    want = {r.job_id: (set(), set()) for r in jobs.collect()}
    for r in pairs:
        for i, x in enumerate(levels.values()):
            if r.s is not None and r.s >= x:
                want[r.job_id][i].add(r.value)
    assert got == want and any(a != b for a, b in got.values())


def test_roles_are_classified_once(spark):
    people = spark.createDataFrame([(1, ["Software Engineer", "IT Officer"]), (2, []), (3, None), (4, ["Software Engineer", "IT Officer"]), (5, ["Gardener"])], "user_id int, roles array<string>")
    got = {r.user_id: (sorted(r.p_roles), sorted(r.p_role_categories)) for r in X.with_roles(people, "roles").collect()}
    assert got[1] == got[4] and len(got[1][0]) == 2 and got[2] == got[3] == ([], [])
    assert len(got) == 5 and len(got[5][1]) == 1
