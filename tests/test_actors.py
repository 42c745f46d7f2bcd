from lexmill.operators import actors


def of(text):
    found = {}
    for a in actors.actors_of(text):
        found.setdefault(a.role, []).append(a.name)
    return found


def test_roles_and_lists():
    text = (
        "ACCIONANTE: PARTE ALFA BETA CONTRA la Alcaldía de Girón. Accionado: Secretaría de Educación - EPS Norte y la Gobernación.\n"
        "vincúlese de oficio a Ministerio Uno, al Instituto Dos y la Entidad Tres. actúa como agente oficiosa de su hija PARTE GAMA DELTA, la menor PARTE GAMA DELTA.\n"
        "Juez: Letrada Cuatro Cinco\nProyectó: Letrado Uno Dos\nRevisó: LETRADO UNO DOS"
    )
    assert of(text) == {
        "CLAIMANT": ["PARTE ALFA BETA"], "DEFENDANT": ["Alcaldía de Girón", "Secretaría de Educación", "EPS Norte", "Gobernación"], "LINKED": ["Ministerio Uno", "Instituto Dos", "Entidad Tres"],
        "JUDGE": ["Letrada Cuatro Cinco"], "LAWYER": ["Letrado Uno Dos"], "MINOR": ["PARTE GAMA DELTA"],
    }


def test_the_surest_formula_counts_and_places_hold():
    text = "promovida por el señor PARTE ALFA BETA contra la EPS. " + "x " * 20_000 + "Accionante: Parte Alfa Beta"
    found = [a for a in actors.actors_of(text) if a.role == "CLAIMANT"]
    assert [(a.name, a.confidence) for a in found] == [("Parte Alfa Beta", 0.9)]
    assert all(text[a.start :].startswith(a.name.split()[0]) for a in actors.actors_of(text) if a.role == "CLAIMANT")
    assert actors.actors_of(None) == [] == actors.actors_of("")


def test_actors_of_cases(spark):
    df = spark.createDataFrame([(1, 7, "Proyectó: Letrado Úno Dos"), (2, 7, "Revisó: LETRADO UNO DOS\nAccionante: Parte Alfa"), (3, 7, None), (4, 8, "nada")], "id bigint, case_id bigint, text string")
    got = actors.actors_of_cases(actors.actors(df, "id", "text"), df, "id", "case_id").collect()
    assert sorted((r["case_id"], r["role"], r["folded"], r["name"], r["documents"]) for r in got) == [(7, "CLAIMANT", "PARTE ALFA", "Parte Alfa", 1), (7, "LAWYER", "LETRADO UNO DOS", "Letrado Úno Dos", 2)]


def test_the_case_goes_with_the_actors(spark):
    df = spark.createDataFrame([(1, 7, "Proyectó: Letrado Úno Dos"), (2, 7, "Revisó: LETRADO UNO DOS"), (3, None, "Accionante: Parte Alfa"), (4, 8, "VİNCULADOS: la Entidad Tres")], "id bigint, case_id bigint, text string")
    got = actors.actors_of_cases(actors.actors(df, "id", "text", "case_id"), df, "id", "case_id")
    assert sorted((str(r["case_id"]), r["role"], r["folded"], r["documents"]) for r in got.collect()) == [("7", "LAWYER", "LETRADO UNO DOS", 2), ("8", "LINKED", "ENTIDAD TRES", 1), ("None", "CLAIMANT", "PARTE ALFA", 1)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
