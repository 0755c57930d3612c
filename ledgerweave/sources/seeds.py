"""Seed tables: issues, scorecards, coverage, corporations by rank, brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Issue | description.
ISSUES = """
civil_liberties|Civil liberties including free speech, due process, and privacy rights
environment|Environmental protection, climate change policy, and conservation
digital_rights|Digital privacy, surveillance, net neutrality, and online freedoms
labor|Workers rights, union protections, wages, and workplace safety
lgbtq_rights|LGBTQ+ equality, anti-discrimination protections, and marriage rights
immigration|Immigration policy, border security, and refugee/asylum policy
gun_policy|Firearm regulation, gun rights, and gun violence prevention
healthcare|Healthcare access, insurance policy, and public health
education|Education funding, school choice, and higher education policy
fiscal_policy|Taxation, government spending, and budget policy
"""

# Scorecard | methodology address | issues covered.
SCORECARDS = """
ACLU|https://www.aclu.org/legislative-scorecard|civil_liberties digital_rights
League of Conservation Voters|https://scorecard.lcv.org/|environment
Human Rights Campaign|https://www.hrc.org/resources/congressional-scorecard|lgbtq_rights
AFL-CIO|https://aflcio.org/scorecard|labor
EFF|https://www.eff.org/issues|digital_rights
"""

# Corporation | ticker (empty: private) | sector, in order of rank.
CORPORATIONS = """
Walmart|WMT|Retail
Amazon|AMZN|Retail
Apple|AAPL|Technology
UnitedHealth Group|UNH|Healthcare
Berkshire Hathaway|BRK.A|Financial Services
CVS Health|CVS|Healthcare
Exxon Mobil|XOM|Energy
Alphabet|GOOGL|Technology
McKesson|MCK|Healthcare
Cencora|COR|Healthcare
Costco Wholesale|COST|Retail
JPMorgan Chase|JPM|Financial Services
Microsoft|MSFT|Technology
Cardinal Health|CAH|Healthcare
Chevron|CVX|Energy
Cigna Group|CI|Insurance
Ford Motor|F|Automotive
Bank of America|BAC|Financial Services
General Motors|GM|Automotive
Elevance Health|ELV|Healthcare
Citigroup|C|Financial Services
Centene|CNC|Healthcare
Home Depot|HD|Retail
Marathon Petroleum|MPC|Energy
Kroger|KR|Retail
Phillips 66|PSX|Energy
Fannie Mae|FNMA|Financial Services
Walgreens Boots Alliance|WBA|Healthcare
Valero Energy|VLO|Energy
Meta Platforms|META|Technology
Verizon Communications|VZ|Telecommunications
AT&T|T|Telecommunications
Comcast|CMCSA|Telecommunications
Wells Fargo|WFC|Financial Services
Goldman Sachs Group|GS|Financial Services
Freddie Mac|FMCC|Financial Services
Target|TGT|Retail
Humana|HUM|Healthcare
State Farm Insurance||Insurance
Tesla|TSLA|Automotive
Morgan Stanley|MS|Financial Services
Johnson & Johnson|JNJ|Pharmaceuticals
Archer Daniels Midland|ADM|Food & Agriculture
PepsiCo|PEP|Consumer Goods
UPS|UPS|Transportation
FedEx|FDX|Transportation
Walt Disney|DIS|Media & Entertainment
Dell Technologies|DELL|Technology
Lowe's|LOW|Retail
Procter & Gamble|PG|Consumer Goods
Energy Transfer|ET|Energy
Boeing|BA|Aerospace & Defense
Albertsons|ACI|Retail
Sysco|SYY|Food & Agriculture
RTX|RTX|Aerospace & Defense
General Electric|GE|Industrial
Lockheed Martin|LMT|Aerospace & Defense
American Express|AXP|Financial Services
Caterpillar|CAT|Industrial
MetLife|MET|Insurance
HCA Healthcare|HCA|Healthcare
Progressive|PGR|Insurance
IBM|IBM|Technology
Deere|DE|Industrial
Nvidia|NVDA|Technology
StoneX Group|SNEX|Financial Services
Merck|MRK|Pharmaceuticals
ConocoPhillips|COP|Energy
Pfizer|PFE|Pharmaceuticals
Delta Air Lines|DAL|Transportation
TD Synnex|SNX|Technology
Publix Super Markets||Retail
Allstate|ALL|Insurance
Cisco Systems|CSCO|Technology
Nationwide||Insurance
Charter Communications|CHTR|Telecommunications
AbbVie|ABBV|Pharmaceuticals
New York Life Insurance||Insurance
Intel|INTC|Technology
TJX|TJX|Retail
Prudential Financial|PRU|Financial Services
HP|HPQ|Technology
United Airlines Holdings|UAL|Transportation
Performance Food Group|PFGC|Food & Agriculture
Tyson Foods|TSN|Food & Agriculture
American Airlines Group|AAL|Transportation
Liberty Mutual Insurance Group||Insurance
Nike|NKE|Consumer Goods
Oracle|ORCL|Technology
Enterprise Products Partners|EPD|Energy
Capital One Financial|COF|Financial Services
Plains GP Holdings|PAGP|Energy
World Kinect|WKC|Energy
AIG|AIG|Insurance
Coca-Cola|KO|Consumer Goods
TIAA||Financial Services
CHS||Food & Agriculture
Bristol-Myers Squibb|BMY|Pharmaceuticals
Dow|DOW|Chemicals
Best Buy|BBY|Retail
"""

# Brands to resolve first.
BRANDS = """
Amazon Basics
Apple
Samsung
Sony
LG
Bose
Nike
Adidas
Under Armour
Levi's
Hasbro
Mattel
Procter & Gamble
Unilever
Johnson & Johnson
Colgate-Palmolive
Nestle
PepsiCo
Coca-Cola
General Mills
Kellogg's
Kraft Heinz
Mars
Mondelez
Hershey
Tyson Foods
3M
Honeywell
General Electric
Whirlpool
Black & Decker
Duracell
Energizer
Clorox
SC Johnson
Church & Dwight
Estee Lauder
L'Oreal
Revlon
Maybelline
Microsoft
Google
Intel
AMD
NVIDIA
HP
Dell
Lenovo
ASUS
Acer
"""


def rows(text: str) -> list[list[str]]:
    return [line.split("|") for line in text.strip().splitlines()]


def issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(ISSUES), "name string, description string")


def scorecards(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([row[:2] for row in rows(SCORECARDS)], "org_name string, methodology_url string")


def covers(spark: SparkSession) -> DataFrame:
    pairs = [(org, issue) for org, _, issues in rows(SCORECARDS) for issue in issues.split()]
    return spark.createDataFrame(pairs, "org_name string, issue_name string")


def corporations(spark: SparkSession) -> DataFrame:
    listed = [(name, ticker or None, rank, sector) for rank, (name, ticker, sector) in enumerate(rows(CORPORATIONS), 1)]
    return spark.createDataFrame(listed, "name string, ticker string, fortune100_rank int, sector string")


def brands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b,) for b in BRANDS.strip().splitlines()], "name string")
