"""A corpus of CVs made from ``customer`` by one SQL expression that Spark and DuckDB read alike."""

CV_TEXT = """
CASE c_custkey % 6 WHEN 0 THEN 'Astrit Patozi' WHEN 1 THEN 'Blerina Hoxha' WHEN 2 THEN 'Martin Repa' WHEN 3 THEN 'Ilir Krasniqi' WHEN 4 THEN 'Diana Smith' ELSE 'Sara Luka' END || chr(10) ||
CASE WHEN c_custkey % 3 = 0 THEN 'Software Developer' ELSE 'officer for retail' END || chr(10) || chr(10) ||
'Email: user' || CAST(c_custkey AS STRING) || '@mail' || CAST(c_custkey % 10 AS STRING) || '.com' || chr(10) ||
'Phone: ' || CASE c_custkey % 4 WHEN 0 THEN '+355 69 ' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || ' ' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
  WHEN 1 THEN '+35567' || lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0') WHEN 2 THEN '068-' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
  ELSE '00355 42 ' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || ' ' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') END || chr(10) ||
'Date of Birth: ' || CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 28 + 1 AS STRING) || '/' || CAST(c_custkey % 12 + 1 AS STRING) || '/' || CAST(1960 + c_custkey % 40 AS STRING)
  ELSE CAST(c_custkey % 28 + 1 AS STRING) || ' March ' || CAST(1960 + c_custkey % 40 AS STRING) END || chr(10) ||
CASE WHEN c_custkey % 5 < 2 THEN 'ID: K' || lpad(CAST(c_custkey AS STRING), 8, '6') || 'M' || chr(10) ELSE '' END ||
CASE WHEN c_custkey % 5 = 2 THEN 'Passport: BA' || lpad(CAST(c_custkey AS STRING), 7, '1') || chr(10) ELSE '' END ||
CASE WHEN c_custkey % 7 = 1 THEN 'IBAN: AL47 2121 1009 0000 0002 3569' || chr(10) ELSE '' END ||
'Address: Rruga e Kavajes ' || CAST(c_custkey % 90 AS STRING) || ', Tirana' || chr(10) ||
CASE c_custkey % 5 WHEN 0 THEN 'Marital status: married' WHEN 1 THEN 'Single' WHEN 2 THEN 'Divorced' ELSE 'no status' END || chr(10) ||
CASE WHEN c_custkey % 4 = 0 THEN 'Gender: Male' WHEN c_custkey % 4 = 1 THEN 'Female' ELSE 'not said' END || chr(10) ||
CASE WHEN c_custkey % 6 = 2 THEN 'Religion: Catholic' ELSE 'none stated' END || chr(10) ||
CASE WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 4 AS STRING) || ' children' ELSE 'no family data' END || chr(10) ||
'linkedin.com/in/user-' || CAST(c_custkey AS STRING) || chr(10) || chr(10) ||
'EXPERIENCE' || chr(10) || CASE c_custkey % 4 WHEN 0 THEN 'Credins Bank' WHEN 1 THEN 'Acme Trading Ltd' WHEN 2 THEN 'Alpha Solutions sh.p.k' ELSE 'Softec Consult' END || ', ' ||
CASE c_custkey % 3 WHEN 0 THEN 'Durres' WHEN 1 THEN 'Vlore' ELSE 'Shkoder' END || chr(10) || 'Team lead in Vienna, Austria' || chr(10) || chr(10) ||
'EDUCATION' || chr(10) || 'University of ' || CASE WHEN c_custkey % 2 = 0 THEN 'Tirana' ELSE 'Economics' END || ', Bachelor' || chr(10)
"""

CVS = f"SELECT c_custkey AS cv_id, {CV_TEXT} AS text FROM customer"

#: Masked texts as the sanitiser gets them.
MASKED_TEXT = """
'Date of birth: [DOB_1] Phone number: [PHONE_1] (Mobile) E-mail: [EMAIL_1]' || chr(10) ||
CASE c_custkey % 4 WHEN 0 THEN 'EXPERIENCE' WHEN 1 THEN 'EDUCATION' WHEN 2 THEN 'CERTIFICATIONS' ELSE 'SUMMARY' END || chr(10) ||
'[ORG_2] in [LOCATION_1],  Vienna and Czech Republic' || chr(10) || '   ' || chr(10) || '--' || chr(10) || chr(10) || chr(10) ||
'worked with xanterra and Semos Education on Udemy' || chr(10) || 'Dr. Anna Berg and Mark Andrews' || chr(10) || 'lists [ORG_1]luding all' || CAST(c_custkey AS STRING) || chr(10)
"""
MASKED = f"SELECT c_custkey AS cv_id, {MASKED_TEXT} AS text FROM customer"

#: Random spans, a few for each group, from line items.
SPANS = """SELECT l_orderkey AS grp, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS entity_type,
CAST(l_partkey % 50 AS INT) AS b, CAST(l_partkey % 50 + 1 + l_suppkey % 9 AS INT) AS e, CAST(l_linenumber AS INT) AS seq FROM lineitem"""
