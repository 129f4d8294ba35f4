"""Contact operators over orders and customers: an order is a directory record of its customer's firm."""

from pyspark.sql import functions as F

from leadflow.catalog.base import case, mod, query, table, text, view
from leadflow.operators import contacts

TITLES = {
    0: "CEO", 1: "Executive Assistant to the CEO", 2: "Founder / C.E.O.", 3: "Head of Sales | CEO, Brazil", 4: "Director of Growth",
    5: "", 6: "CEO | Analyst", 7: "VP of Sales, Europe", 8: "Office of CEO",
}
TITLE_SQL = "CASE o_orderkey % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in TITLES.items()) + " END"
view(
    "directory",
    f"""SELECT 'c' || (o_custkey // 2) || '.example.com' AS domain, o_orderkey % 2 AS title_idx, o_orderkey AS pos, {TITLE_SQL} AS title,
        CASE WHEN o_orderkey % 37 = 5 THEN '(Sample' WHEN o_orderkey % 11 = 4 THEN '' ELSE ' Ann' || (o_orderkey % 3) || ' ' END AS first_name,
        CASE WHEN o_orderkey % 11 = 4 THEN NULL WHEN o_orderkey % 41 = 7 THEN 'Do Not Contact' ELSE 'Lee' || (o_custkey % 2) END AS last_name,
        CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN NULL ELSE ' A' || (o_orderkey % 7) || '@Example.com' END AS email,
        CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '+1' || o_orderkey END AS employee_phone, CASE WHEN o_orderkey % 2 = 0 THEN '+2' || o_orderkey END AS phone,
        CASE WHEN o_orderkey % 4 = 0 THEN '+3' || o_orderkey END AS mobile_phone,
        CASE WHEN o_orderkey % 3 = 0 THEN 'https://linkedin.com/in/p' || (o_custkey % 500) END AS employee_linkedin
        FROM orders""",
)


def directory(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        text("c", F.floor(F.col("o_custkey") / 2), ".example.com").alias("domain"), (k % 2).alias("title_idx"), k.alias("pos"),
        case(k % 9, TITLES).alias("title"),
        F.when(k % 37 == 5, "(Sample").when(k % 11 == 4, "").otherwise(text(" Ann", k % 3, " ")).alias("first_name"),
        F.when(k % 11 == 4, F.lit(None)).when(k % 41 == 7, "Do Not Contact").otherwise(text("Lee", mod("o_custkey", 2))).alias("last_name"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, "n/a").when(k % 5 != 2, text(" A", k % 7, "@Example.com")).alias("email"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, text("+1", k)).alias("employee_phone"),
        F.when(k % 2 == 0, text("+2", k)).alias("phone"), F.when(k % 4 == 0, text("+3", k)).alias("mobile_phone"),
        F.when(k % 3 == 0, text("https://linkedin.com/in/p", mod("o_custkey", 500))).alias("employee_linkedin"),
    )


view(
    "records",
    """SELECT domain, title_idx, pos, coalesce(title, '') AS title, trim(coalesce(first_name, '')) AS first_name, trim(coalesce(last_name, '')) AS last_name,
       trim(coalesce(email, '')) AS email, CASE WHEN employee_phone <> '' THEN employee_phone ELSE coalesce(phone, '') END AS phone,
       coalesce(mobile_phone, '') AS mobile, coalesce(employee_linkedin, '') AS linkedin_url FROM directory""",
    ("directory",),
)


@query("contact_records", "SELECT * FROM records", ("records",))
def contact_records(spark, d):
    return contacts.contact_records(directory(spark, d)).select("domain", "title_idx", "pos", "contact.*")


# CEO is strict, 'sales' is not
WANTED = ["CEO", "Sales"]
FITS = "(pos % 9 IN (0, 2, 3, 6, 7))"


@query("title_filter", f"SELECT domain, pos, title FROM records WHERE {FITS}", ("records",))
def title_filter(spark, d):
    return contacts.title_filter(directory(spark, d), WANTED).select("domain", "pos", F.coalesce("title", F.lit("")).alias("title"))


REAL = "lower(first_name || ' ' || last_name) NOT LIKE '%(sample%' AND lower(first_name || ' ' || last_name) NOT LIKE '%do not contact%'"


@query("placeholder_filter", f"SELECT domain, pos FROM records WHERE {REAL}", ("records",))
def placeholder_filter(spark, d):
    return contacts.placeholder_filter(directory(spark, d)).select("domain", "pos")


view(
    "domain_lists",
    f"""SELECT domain, r, title, first_name, last_name, email, phone, mobile, linkedin_url FROM (
        SELECT *, row_number() OVER (PARTITION BY domain ORDER BY title_idx, pos) AS r FROM (
          SELECT *, row_number() OVER (PARTITION BY domain, key ORDER BY title_idx, pos) AS n FROM (
            SELECT *, CASE WHEN email <> '' AND upper(email) <> 'N/A' THEN 'm' || lower(email) WHEN first_name <> '' OR last_name <> '' THEN 'n' || lower(first_name || '|' || last_name)
                      ELSE 'r' || pos END AS key FROM records WHERE {FITS} AND {REAL})) WHERE n = 1)""",
    ("records",),
)


def domain_lists(spark, d):
    return contacts.domain_contacts(directory(spark, d), WANTED)


@query("domain_contacts", "SELECT * FROM domain_lists", ("domain_lists",))
def domain_contacts(spark, d):
    return _listed_contacts(domain_lists(spark, d))


@query("domain_contacts_first_3", "SELECT * FROM domain_lists WHERE r <= 3", ("domain_lists",))
def domain_contacts_first_3(spark, d):
    return _listed_contacts(contacts.domain_contacts(directory(spark, d), WANTED, 3))


def _listed_contacts(found):
    lists = found.select("domain", F.posexplode("contacts").alias("_p", "c"))
    return lists.select("domain", (F.col("_p") + 1).cast("long").alias("r"), "c.*")


ACCENTS = {0: "Zoë Müller", 1: "JOSÉ  Peña (Sample)", 2: "ann-marie o'neil 3rd", 3: "Łukasz Żak", 4: "Ångström"}
NAME_SQL = {0: "zoe muller", 1: "jose  pena sample", 2: "annmarie oneil rd", 3: "łukasz zak", 4: "angstrom"}


def _kinds(options):
    return " ".join(f"WHEN {k} THEN '" + v.replace("'", "''") + "'" for k, v in options.items())


@query(
    "normalize_names",
    f"SELECT c_custkey, CASE c_custkey % 6 {_kinds(ACCENTS)} ELSE c_name END AS full_name, CASE c_custkey % 6 {_kinds(NAME_SQL)} ELSE 'customer' END AS normalized_name FROM customer",
)
def normalize_names(spark, d):
    named = table(spark, d, "customer").select("c_custkey", case(mod("c_custkey", 6), ACCENTS, F.col("c_name")).alias("full_name"))
    return contacts.normalize_names(named, "full_name")


PAIRS = [  # contact first, contact last, expected, fits
    ("Tobias", "Lütke", "Tobi Lutke", True), ("Pat", "Smith", "Patrick Smith", True), ("Ann", "Smith", "Bob Smith", False), ("X", "Y", "Madonna", True),
    ("", "Smith", "Bob Smith", True), ("Bob", "van Smith", "Bob van Smith", False), ("Bob", "Smith", "", True),
]


@query(
    "person_match",
    "SELECT c_custkey, first_name, last_name, full_name, matches FROM customer JOIN (VALUES "
    + ", ".join(f"({i}, '{f}', '{la}', '{e}', {str(m).lower()})" for i, (f, la, e, m) in enumerate(PAIRS))
    + f") AS p(i, first_name, last_name, full_name, matches) ON c_custkey % {len(PAIRS)} = i",
)
def person_match(spark, d):
    pick = lambda n: case(mod("c_custkey", len(PAIRS)), {i: p[n] for i, p in enumerate(PAIRS)})
    rows = table(spark, d, "customer").select("c_custkey", pick(0).alias("first_name"), pick(1).alias("last_name"), pick(2).alias("full_name"))
    return contacts.person_match(rows)


@query(
    "split_full_names",
    """SELECT c_custkey, full_name, CASE c_custkey % 4 WHEN 0 THEN 'Mary Anne' WHEN 1 THEN 'Cher' WHEN 2 THEN '' ELSE 'Bo' END AS first_name,
       CASE c_custkey % 4 WHEN 0 THEN 'Smith' || c_custkey WHEN 3 THEN 'Li' ELSE '' END AS last_name
       FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' Mary  Anne Smith' || c_custkey WHEN 1 THEN 'Cher' WHEN 2 THEN '  ' ELSE 'Bo Li ' END AS full_name FROM customer)""",
)
def split_full_names(spark, d):
    c = F.col("c_custkey")
    name = case(c % 4, {0: text(" Mary  Anne Smith", c), 1: "Cher", 2: "  "}, "Bo Li ")
    return contacts.split_full_names(table(spark, d, "customer").select("c_custkey", name.alias("full_name")))


# people: pairs of customers ask for the same person
view(
    "wanted_people",
    """SELECT c_custkey AS row_index, CASE WHEN c_custkey % 12 = 10 THEN '' WHEN c_custkey % 4 < 2 THEN 'Ann1 Lee' || (c_custkey // 4 % 2) ELSE 'ANN2 Lee' || (c_custkey // 4 % 2) END AS full_name,
       CASE WHEN c_custkey % 10 = 8 THEN NULL ELSE 'c' || (c_custkey // 4) || '.example.com' END AS domain,
       CASE WHEN c_custkey % 4 < 2 AND c_custkey // 4 % 3 = 1 THEN 'https://linkedin.com/in/p' || (c_custkey // 4 % 600) ELSE '' END AS linkedin_url FROM customer""",
)


def wanted_people(spark, d):
    k = F.col("c_custkey")
    g = F.floor(k / 4)
    return table(spark, d, "customer").select(
        k.alias("row_index"),
        F.when(k % 12 == 10, "").when(k % 4 < 2, text("Ann1 Lee", g % 2)).otherwise(text("ANN2 Lee", g % 2)).alias("full_name"),
        F.when(k % 10 != 8, text("c", g, ".example.com")).alias("domain"),
        F.when((k % 4 < 2) & (g % 3 == 1), text("https://linkedin.com/in/p", g % 600)).otherwise("").alias("linkedin_url"),
    )


view(
    "found_people",
    f"""SELECT w.row_index, w.full_name, w.domain, w.linkedin_url, coalesce(u.pos, n.pos) AS pos FROM wanted_people w
        LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY linkedin_url ORDER BY pos) AS n FROM records WHERE linkedin_url <> '') WHERE n = 1 AND {REAL}) u
          ON u.linkedin_url = w.linkedin_url
        LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, lower(first_name), lower(last_name) ORDER BY pos) AS n FROM records
                   WHERE first_name <> '' AND last_name <> '') WHERE n = 1 AND {REAL}) n
          ON n.domain = w.domain AND lower(n.first_name || ' ' || n.last_name) = lower(w.full_name)""",
    ("wanted_people", "records"),
)
view(
    "person_contacts",
    """SELECT f.row_index, f.pos, r.title, r.first_name, r.last_name, r.email, r.phone, r.mobile, r.linkedin_url
       FROM found_people f LEFT JOIN records r ON r.pos = f.pos""",
    ("found_people", "records"),
)


@query(
    "person_lookup",
    """SELECT f.row_index, f.full_name, f.domain, f.linkedin_url, r.email, r.phone, r.linkedin_url AS found_url FROM found_people f LEFT JOIN records r ON r.pos = f.pos""",
    ("found_people", "records"),
)
def person_lookup(spark, d):
    out = contacts.person_lookup(wanted_people(spark, d), directory(spark, d))
    return out.select("row_index", "full_name", "domain", "linkedin_url", "contact.email", "contact.phone", F.col("contact.linkedin_url").alias("found_url"))


@query(
    "person_fan_out",
    """SELECT p.row_index, p.title, p.email, p.phone FROM person_contacts p JOIN wanted_people w USING (row_index)
       WHERE w.full_name <> '' AND (w.domain <> '' OR w.linkedin_url <> '')""",
    ("person_contacts", "wanted_people"),
)
def person_fan_out(spark, d):
    out = contacts.person_fan_out(wanted_people(spark, d), directory(spark, d))
    return out.select("row_index", "contact.title", "contact.email", "contact.phone")


# rows of the firms, some without a domain; some look-ups failed
view(
    "rows_for_contacts",
    """SELECT c_custkey AS row_index, CASE WHEN c_custkey % 5 <> 4 THEN 'c' || (c_custkey // 3) || '.example.com' END AS normalized_domain,
       CASE WHEN c_custkey % 2 = 0 THEN 'Annabel Lee' || (c_custkey % 4 // 2) ELSE '' END AS full_name, 'extracted' AS status FROM customer""",
)
view(
    "outcomes",
    """SELECT domain, count(*) AS n, string_agg(first_name || '/' || last_name || '/' || email, ';' ORDER BY r) AS people,
       string_agg(CASE WHEN last_name = 'Lee0' THEN first_name || '/' || last_name || '/' || email END, ';' ORDER BY r) AS lee0,
       string_agg(CASE WHEN last_name = 'Lee1' THEN first_name || '/' || last_name || '/' || email END, ';' ORDER BY r) AS lee1 FROM domain_lists GROUP BY domain""",
    ("domain_lists",),
)


def rows_for_contacts(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("row_index"), F.when(k % 5 != 4, text("c", F.floor(k / 3), ".example.com")).alias("normalized_domain"),
        F.when(k % 2 == 0, text("Annabel Lee", F.floor(k % 4 / 2))).otherwise("").alias("full_name"), F.lit("extracted").alias("status"),
    )


def fanned(spark, d):
    found = domain_lists(spark, d).withColumn("error", F.lit(None).cast("string"))
    failed = table(spark, d, "customer").filter(mod("c_custkey", 3) == 0).select(
        text("c", F.floor(F.col("c_custkey") / 3), ".example.com").alias("domain"), contacts.no_contacts().alias("contacts"), F.lit("HTTPError: 503").alias("error")
    )
    return contacts.domain_fan_out(rows_for_contacts(spark, d), found.unionByName(failed.join(found, "domain", "left_anti")))


def people_text(c):
    return F.array_join(F.transform(c, lambda x: F.concat_ws("/", x["first_name"], x["last_name"], x["email"])), ";")


@query(
    "domain_fan_out",
    """SELECT row_index, normalized_domain, full_name, status, CASE WHEN normalized_domain IS NOT NULL THEN coalesce(people, '') END AS people,
       CASE WHEN normalized_domain IS NOT NULL AND people IS NULL THEN 'HTTPError: 503' END AS enrich_error FROM rows_for_contacts LEFT JOIN outcomes ON domain = normalized_domain""",
    ("rows_for_contacts", "outcomes"),
)
def domain_fan_out(spark, d):
    return fanned(spark, d).withColumn("people", people_text(F.col("found_contacts"))).drop("found_contacts")


@query(
    "apply_contacts",
    """SELECT row_index, normalized_domain, full_name, people, CASE WHEN people <> '' THEN 'enriched' ELSE 'extracted' END AS status FROM (
       SELECT *, CASE WHEN normalized_domain IS NOT NULL THEN coalesce(CASE full_name WHEN 'Annabel Lee0' THEN shown0 WHEN 'Annabel Lee1' THEN shown1 ELSE shown END, '') END AS people
       FROM (SELECT r.*, o.people AS shown, coalesce(l.same, '') AS shown0, coalesce(l.same, '') AS shown1 FROM rows_for_contacts r
             LEFT JOIN outcomes o ON o.domain = r.normalized_domain
             LEFT JOIN (SELECT domain, string_agg(first_name || '/' || last_name || '/' || email, ';' ORDER BY r) AS same FROM domain_lists
                        WHERE regexp_replace(lower(last_name), '[^a-z]', '', 'g') = 'lee' AND (first_name = '' OR lower(first_name) LIKE 'an%') GROUP BY domain) l
               ON l.domain = r.normalized_domain))""",
    ("rows_for_contacts", "outcomes", "domain_lists"),
)
def apply_contacts(spark, d):
    out = contacts.apply_contacts(fanned(spark, d), match_names=True)
    return out.withColumn("people", people_text(F.col("contacts"))).drop("contacts", "enrich_error")
