"""Tagged records, nested entries, and the tables that come of them."""

from remedex.operators.compile import write_by
from remedex.sources import flat, nested

PROTEIN = """ID   ABC1_HUMAN              Reviewed;         120 AA.
AC   P12345; Q00001; Q00002;
AC   Q00003;
DE   RecName: Full=First
DE   name; Short=FN;
DE   AltName: Full=Other name;
OX   NCBI_TaxID=9606 {ECO:1};
OC   Eukaryota; Metazoa;
OC   Homo.
RX   PubMed=111; DOI=10.1/x;
RX   PubMed=222;
CC   -!- FUNCTION: Does
CC       things with P99999.
CC   -!- INTERACTION:
CC       Q11111; P12345: X; NbExp=3;
CC       Q22222; P12345: Y;
CC   -!- DISEASE: Some disease (SD) [MIM:100]: text; and MIM:200
DR   GO; GO:0000001; F:binding; IEA:X.
DR   GO; GO:0000002; P:process; IEA:X.
DR   GO; GO:0000003; C:part; IEA:X.
DR   HPA; HPA001; -.
DR   Reactome; R-HSA-1; Path.
DR   DrugBank; DB00001; Drug.
DR   InterPro; IPR000001; Fam.
DR   InterPro; IPR000009; Unknown.
DR   PROSITE; PS00001; X; 1.
KW   Kinase; Membrane
KW   protein.
FT   CHAIN           1..120
SQ   SEQUENCE   120 AA;
     MKV LLL
"""


def test_protein_entries(spark, tmp_path):
    other = PROTEIN.replace("9606", "12").replace("P12345", "P77777")
    bare = "ID   Z_MOUSE X\nAC   O00001;\nOX   NCBI_TaxID=10090;\n"
    (tmp_path / "a.dat").write_text(PROTEIN + "//\n" + other + "//\n" + bare + "//\n")
    texts = flat.read_texts(spark, f"{tmp_path}/a.dat")
    families = spark.createDataFrame([("IPR000001", "Family")], "family string, family_type string")
    got = {}
    for r in flat.protein_statements(texts, families).collect():
        got.setdefault((r.kind, r.source), set()).add((r.edge_type, r.target))
    assert got["metadata", "P12345"] == {
        ("OTHER_ID", "Q00002"), ("OTHER_ID", "Q00003"), ("NAME", "ABC1"), ("SPECIES", "HUMAN"), ("FULL_NAME", "First name"), ("FULL_NAME", "Other name"), ("SHORT_NAME", "FN"),
        ("ORGANISM_CLASS", "Eukaryota"), ("ORGANISM_CLASS", "Metazoa"), ("ORGANISM_CLASS", "Homo."), ("RELATED_PUBMED_ID", "pubmed:111"), ("RELATED_PUBMED_ID", "pubmed:222"),
        ("RELATED_KEYWORD", "Kinase"), ("RELATED_KEYWORD", "Membrane protein"),
    }
    assert got["facts", "P12345"] == {
        ("GO_BP", "GO:0000001"), ("GO_MF", "GO:0000002"), ("GO_CC", "GO:0000003"), ("RELATED_ANTIBODY", "HPA001"), ("RELATED_PATHWAY", "R-HSA-1"), ("TARGET_OF_DRUG", "DB00001"),
        ("FAMILY", "IPR000001"), ("PS_SEQ_ANN", "PS00001"), ("RELATED_GENETIC_DISORDER", "MIM:100"), ("RELATED_GENETIC_DISORDER", "MIM:200"),
    }
    assert got["interactions", "P12345"] == {("INTERACTS_WITH", x) for x in ("Q11111", "Q22222", "P12345")}
    assert got["metadata", "O00001"] == {("NAME", "Z"), ("SPECIES", "MOUSE")} and {k[1] for k in got} == {"P12345", "O00001"}


def test_families(spark):
    text = ["about (X1)", "====", "AGC Ser/Thr kinase", "====", "AKT1 (P31749) (P31750 )", "x", "===", "Atypical: PI3/PI4-kinase family", "===", "(A1)", "===", "Atypical: ADCK", "===", "(B1)"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, line int, value string")
    assert {tuple(r) for r in flat.family_members(df).collect()} == {("P31749", "KINASE_FAMILY", "AGC"), ("P31750", "KINASE_FAMILY", "AGC"), ("A1", "KINASE_FAMILY", "AT_PI3/PI4"), ("B1", "KINASE_FAMILY", "AT_ADCK")}


def test_cell_lines(spark, tmp_path):
    (tmp_path / "c.txt").write_text("""----\n Description: cells\n
ID   #HeLa-1
AC   CVCL_0001
SY   HeLa 1; H-1
DR   GEO; GSM1
DR   BTO; BTO:1
DR   GEO; GSM2
RX   PubMed=11; PubMed=12;
RX   PubMed=13;
DI   NCIt; C1; Carcinoma
OX   NCBI_TaxID=9606; ! Homo sapiens
OX   NCBI_TaxID=10090; ! Mus musculus
SX   Sex unspecified
CA   Cancer cell line
//
ID   B
AC   CVCL_0002
SX   Female
//
""")
    cells = flat.cell_lines(flat.read_texts(spark, f"{tmp_path}/c.txt"))
    t = {k: {tuple(r) for r in v.collect()} for k, v in flat.cell_line_tables(cells).items()}
    assert t["category"] == {("CVCL_0001", "HeLa-1,HeLa 1,H-1", "Homo sapiens,Mus musculus", "unknown", "Cancer cell line", " C1; Carcinoma"), ("CVCL_0002", "B", "unknown", "Female", "", "")}
    assert t["map"] == {("HeLa-1", "CVCL_0001"), ("HeLa 1", "CVCL_0001"), ("H-1", "CVCL_0001"), ("B", "CVCL_0002")}
    assert t["datasets"] == {("CVCL_0001", "GSM1,GSM2")} and t["publications"] == {("CVCL_0001", "11,12,13")}


DRUGS = """<?xml version="1.0"?><drugbank xmlns="http://www.drugbank.ca"><drug type="small"><drugbank-id primary="true">DB1</drugbank-id><drugbank-id>OLD</drugbank-id><name>Drug one</name>
<general-references><articles><article><pubmed-id>77</pubmed-id></article></articles></general-references><mechanism-of-action>Does
it.</mechanism-of-action><classification><description>long</description><direct-parent>A-B</direct-parent><kingdom>Org</kingdom></classification>
<synonyms><synonym language="english">Syn A</synonym><synonym language="german">Syn B</synonym></synonyms><groups><group>approved</group></groups><products><product><name>Prod</name></product><product><name>Prod</name></product></products>
<targets><target><references><articles><article><pubmed-id>5</pubmed-id></article><article><pubmed-id>6</pubmed-id></article></articles></references><actions><action>inhibitor</action><action>other/unknown</action></actions><polypeptide id="P1" source="Swiss-Prot"/></target>
<target><polypeptide id="X" source="TrEMBL"><external-identifiers><external-identifier><resource>GenBank</resource><identifier>G</identifier></external-identifier><external-identifier><resource>UniprotKB</resource><identifier>Q9</identifier></external-identifier></external-identifiers></polypeptide></target><target><name>no protein</name></target></targets>
<enzymes><enzyme><actions><action>substrate</action></actions><polypeptide id="P2" source="Swiss-Prot"/></enzyme></enzymes>
<drug-interactions><drug-interaction><drugbank-id>DB2</drugbank-id><description>The risk or severity of bleeding can be increased when A is combined with B.</description></drug-interaction><drug-interaction><drugbank-id>DB3</drugbank-id><description/></drug-interaction></drug-interactions>
<atc-codes><atc-code code="B01AE02"><level code="B01AE">x</level></atc-code></atc-codes><categories><category><category>c</category><mesh-id>D0001</mesh-id></category><category><mesh-id/></category></categories>
<pathways><pathway><smpdb-id>SMP1</smpdb-id><name>p</name><category>disease</category><drugs><drug><drugbank-id>DB9</drugbank-id><name>inner</name></drug></drugs><enzymes><uniprot-id>P3</uniprot-id><uniprot-id>P4</uniprot-id></enzymes></pathway></pathways></drug>
<drug><drugbank-id primary="true">DB2</drugbank-id><name>Two</name></drug></drugbank>"""


def test_drug_entries_make_all_tables_from_one_scan(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DRUGS)
    entries = nested.read_drugs(spark, f"{tmp_path}/d.xml")
    made = nested.drug_statements(entries)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    write_by(made, "kind", f"{tmp_path}/out")
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault(r.kind, set()).add((r.source, r.edge_type, r.target, r.qualifier, r.references))
    plain = lambda k: {x[:3] for x in got[k]}
    assert plain("meta") == {("DB1", "TYPE", "DRUG"), ("DB1", "NAME", "Drug_one"), ("DB1", "SYNONYM", "Syn_A"), ("DB1", "PUBMED_ARTICLE", "77"), ("DB1", "PRODUCT", "Prod"), ("DB2", "TYPE", "DRUG"), ("DB2", "NAME", "Two")}
    assert plain("stage") == {("DB1", "PRODUCT_STAGE", "approved")} and plain("mechanism") == {("DB1", "MECHANISM", "Does it.")}
    assert plain("classification") == {("DB1", "DIRECT_PARENT", "A_B"), ("DB1", "KINGDOM", "Org")}
    assert got["target"] == {("DB1", "DRUG_TARGET", "P1", "inhibitor", "5,6"), ("DB1", "DRUG_TARGET", "P1", "unknown", "5,6"), ("DB1", "DRUG_TARGET", "Q9", "unknown", None), ("DB1", "DRUG_ENZYME", "P2", "substrate", None)}
    assert got["interaction"] == {("DB1", "DRUG_INTERACTION", "DB2", "increase_bleeding", None), ("DB1", "DRUG_INTERACTION", "DB3", None, None)}
    assert {x[2] for x in got["atc"]} == {"ATC:B", "ATC:B01", "ATC:B01A", "ATC:B01AE", "ATC:B01AE02"} and plain("mesh") == {("DB1", "MESH_CATEGORY", "D0001")}
    assert plain("pathway") == {("DB1", "DRUG_PATHWAY", "SMP1"), ("SMP1", "PATHWAY_CATEGORY", "disease"), ("SMP1", "PATHWAY_ENZYME", "P3"), ("SMP1", "PATHWAY_ENZYME", "P4")}


def test_expression_entries(spark, tmp_path):
    (tmp_path / "e.xml").write_text("""<proteinAtlas><entry><identifier><xref id="P1" db="Uniprot/SWISSPROT"/></identifier>
<tissueExpression><data><tissue>bone marrow</tissue><level>high</level><tissueCell><cellType>red cell</cellType><level>low</level></tissueCell></data><data><cellLine>HeLa</cellLine><tissue>skin</tissue><level>medium</level></data></tissueExpression>
<rnaExpression><data><tissue>liver</tissue><level>detected</level></data><data><cellLine cellosaurusID="CVCL_1" organ="Brain">U 87</cellLine><level expRNA="3.5">x</level></data><data><cellLine cellosaurusID="" organ="Lung">A549</cellLine><level expRNA="1"/></data></rnaExpression>
<antibody id="HPA1"><antigenSequence>MKV</antigenSequence></antibody><antibody id="HPA2"/></entry>
<entry><identifier><xref id="E1" db="Ensembl"/></identifier><antibody id="HPA3"/></entry></proteinAtlas>""")
    got = {(r.kind, r.source, r.edge_type, r.target, r.qualifier) for r in nested.expression_statements(nested.read_expression(spark, f"{tmp_path}/e.xml")).collect()}
    assert got == {
        ("tissue", "P1", "bone_marrow", "high", None), ("tissue", "P1", "bone_marrow__red_cell", "low", None), ("cell_line", "P1", "HeLa", "medium", None), ("tissue", "P1", "skin", "medium", None),
        ("tissue", "P1", "liver", "detected", None), ("cell_line", "P1", "U_87", "NormRNA_EXP:3.5", "Brain#CVCL_1"), ("cell_line", "P1", "A549", "NormRNA_EXP:1", "Lung#NA"),
        ("antibody", "HPA1", "ANTIBODY", "P1", "MKV"), ("antibody", "HPA2", "ANTIBODY", "P1", "-"),
    }


def test_protein_statements_share_their_tags(spark):
    """The folded lines of an entry are worked out once, and statements are made once for facts and families."""
    families = spark.createDataFrame([("I0", "Family")], "family string, family_type string")
    texts = spark.createDataFrame([("ID   X_HUMAN\nAC   P1;\nOX   NCBI_TaxID=9606;\nDR   InterPro; I0; z.\nDR   InterPro; I9; z.",), (None,)], "value string")
    out = flat.protein_statements(texts, families)
    assert sorted(map(tuple, out.where("kind = 'facts'").collect())) == [("facts", "P1", "FAMILY", "I0")]
    assert {r.kind for r in out.collect()} == {"facts", "metadata"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rtrim(") == 1 and "Union" not in plan
