from collections import Counter

from laborloom.llm import sentences
from laborloom.llm.sentences import Model, document_headings, examples_of, headings_of, p10_found, sentence_units, split, train
from tests.conftest import DATA
from tests.llm.tables import folder

CASES = [
    ["Dr. Ruiz will track racks on Fridays, e.g. in building 34.", "Pay rose 34.3 percent, i.e. about $74 a week.", "Shifts end at 8:15 p.m. on weekdays."],
    ["Most of the work is done by 8:30 a.m.", "Pay rose again."],
    ["J. R. Vezihiti, the plant lead, has been with Acme L.L.C. for 11 years.", "The U.S. office in Yuma is new.", "No. 39 on the list is cook."],
    ['"We label charts. Nobody waits," said Ms. Ruiz of Acme Co.', "He wrote: “I track plans. It is fine.”", "Apply now 🎉!", "Wait... is this job in Yuma?"],
    ["“Can I start on Monday?” asked one applicant from Cali.", "See https://acme.example/roles?id=59.16 for details.", "Is it really needed?!", "They use Torq v66.74 daily."],
    ["Wir suchen z. B. Fachkräfte mit 6 Jahren Erfahrung.", "Am 3. Mai beginnt die neue Schicht in Kassel.", "Siehe Abs. 53 bzw. Nr. 18 der Ausschreibung.", "„Ich fange morgen an“, sagte Frau Ruiz.", "Mit Torq u. a. Werkzeugen wird gearbeitet."],
    ["El Dr. Ruiz trabaja en EE. UU. desde hace 7 años.", "¿Necesita experiencia?", "«¿Puedo empezar el lunes?», preguntó la candidata.", "El horario es de 8:30 a. m. a 5 p. m. todos los días."],
    ["M. Ruiz dirige l'équipe.", "Postulez dès aujourd'hui !", "Voir p. 4 du rapport, art. 25.", "Avez-vous un permis ?"],
    ["डॉ. Ruiz इस विभाग की प्रमुख हैं।", "“मैं सोमवार से आ सकता हूँ।” उसने कहा।", "काम 8.30 बजे शुरू होता है।"],
    ["يدير د. Ruiz وردية الليل.", "هل لديك رخصة قيادة؟", "الأجر 9.5 دولار في الساعة."],
]
SPACELESS = [
    ["她说：“我下周一可以上班。”", "“需要驾照吗？”一位求职者问道。", "没有经验也可以……我们会教你。", "时薪为51.21元，每周工作五天。", "请今天就申请！"],
    ["「未経験でも大丈夫です。丁寧に教えます」と店長は話しました。", "勤務時間は8:30から17:00までです。", "「すぐに始められますか。」と応募者が聞きました。"],
]


def units(text, model):
    return [text[a:b] for a, b in split(text, model)]


def test_cases(spark):
    model = train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 400)
    for joint, cases in ((" ", CASES), ("", SPACELESS)):
        for want in cases:
            assert units(joint.join(want), model) == want
    for want in CASES:
        assert units("\n\n".join(want), model) == want
        assert units("\n".join(want), model) == want
    wrapped = "The role asks for a valid driver license\nand two references. Bring them to\nLaredo on Monday."
    assert units(wrapped, model) == ["The role asks for a valid driver license\nand two references.", "Bring them to\nLaredo on Monday."]
    blocks = "Benefits\n• $9.63 per hour, paid weekly\n• a steady hand\nNobody works alone.\n\nRequirements:\n1. two references\n2. good eyesight\n\n  End  "
    assert units(blocks, model) == ["Benefits", "• $9.63 per hour, paid weekly", "• a steady hand", "Nobody works alone.", "Requirements:", "1. two references", "2. good eyesight", "End"]
    assert units("ค่าจ้าง 34 บาทต่อชั่วโมง งานเริ่มตอนเช้า\nผู้สมัครต้องมีใบขับขี่", model) == ["ค่าจ้าง 34 บาทต่อชั่วโมง", "งานเริ่มตอนเช้า", "ผู้สมัครต้องมีใบขับขี่"]
    assert units("Il faut 9 ans.Dr. Ruiz arrive.Postulez !", model) == ["Il faut 9 ans.", "Dr. Ruiz arrive.", "Postulez !"]


def test_edges(spark, tmp_path):
    long = "A short line. " * 20_000
    path = folder(spark, tmp_path, True, documents=[(None, "No id. None."), (1, None), (2, ""), (3, " \n\n "), (4, long), (5, "No end"), (5, "No end"), (6, "((( “““ ... !?")])
    got = Counter(r["doc_id"] for r in p10_found(spark, path).collect())
    assert got[4] == 20_000 and got[5] == 2 and not {1, 2, 3} & set(got)
    assert p10_found(spark, folder(spark, tmp_path / "e", documents=[])).count() == 0


def test_positions_are_code_points(spark):
    text = "🎉🎉 Hi there. Bye now."
    got = sentence_units(spark.createDataFrame([(1, text)], "doc_id long, text string"), train(spark.read.parquet(f"{DATA}/documents.parquet"), 50))
    assert sorted(text[r["start_char"] : r["end_char"]] for r in got.collect()) == ["Bye now.", "🎉🎉 Hi there."]


def test_headings_are_counted_over_all_documents(spark, monkeypatch):
    # the heading stands alone in three documents only, which are longer than those trained on
    monkeypatch.setattr(sentences.train, "__defaults__", (40, 2_000, *sentences.train.__defaults__[2:]))
    plain = [(i, "The shift starts early on Monday. Bring two references.\n\nApply today.") for i in range(40)]
    long = [(100 + i, "What we do here\n\n" + "We pack boxes all day. " * 200) for i in range(3)]
    text = "What we do here\nWe pack boxes. Nobody waits."
    rows = [*plain, *long, (200, text), (201, text.replace("do here", "do there"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], tuple(r["headings"])) for r in document_headings(df).collect()} == {(i, ("What we do here",)) for i in (100, 101, 102, 200)}
    got = [text[r["start_char"] : r["end_char"]] for r in sentence_units(df).filter("doc_id = 200").orderBy("start_char").collect()]
    assert got == ["What we do here", "We pack boxes.", "Nobody waits."]


def test_headings_equal_those_of_one_pass(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").dropna().dropDuplicates(["doc_id"])
    got = {h for r in document_headings(docs).collect() for h in r["headings"]}
    assert got == headings_of([r["text"] for r in docs.collect()])


def test_labels_come_from_structure():
    text = "Reach Dr. Ruiz by noon. The desk is open.\n\nShifts run from 8.30 to noon. Bring tools"
    by_label = {y: [f for f, label in examples_of(text, frozenset()) if label == y] for y in (0, 1)}
    tokens = lambda y: {x[2:] for fs in by_label[y] for x in fs if x.startswith("t=") and "&" not in x}
    assert tokens(1) == {"open"}  # the paragraph's end, read with the next paragraph's start
    assert tokens(0) == {"dr", "8"}  # a short form, a number; "noon" before a capital is ambiguous


def test_collocation_finds_short_forms_and_spares_words():
    seen = sentences.Collocations()
    for i in range(200):
        seen.add(f"Ask Qv. Ruiz at desk {i % 7}. Bring tools. The tools are here now.\n\nNobody waits for the tools.")
    bound = seen.bound()
    assert ("word", "qv") in bound and not {("word", "tools"), ("word", "now")} & bound
    found = Model.fit(examples_of("Ask Qv. Ruiz now.\n\nNobody waits.", frozenset(), bound))
    assert units("Ask Qv. Ruiz now. Nobody waits.", found) == ["Ask Qv. Ruiz now.", "Nobody waits."]


def test_model_decides_where_labels_are_silent(spark):
    # held out: boundaries inside paragraphs, known because the paragraphs were put together from sentences
    model = train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 400)
    right = total = 0
    for joint, cases in ((" ", CASES), ("", SPACELESS)):
        for want in cases:
            got = units(joint.join(want), model)
            right += len(set(got) & set(want))
            total += len(want)
    assert right / total > 0.95


def test_held_out_accuracy(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    headings = headings_of(texts[:500])
    train_set, held = Counter(), Counter()
    for i, t in enumerate(texts):
        (train_set if i < 500 else held).update(examples_of(t, headings))
    model = Model.fit(train_set, headings)
    right = sum(n for (f, y), n in held.items() if (model.score(list(f)) > 0) == (y == 1))
    assert right / sum(held.values()) > 0.995
