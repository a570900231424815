"""Small reference dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Abbreviation, name, conference, division.
TEAMS = """
BUF|Buffalo Bills|AFC|EAST
MIA|Miami Dolphins|AFC|EAST
NE|New England Patriots|AFC|EAST
NYJ|New York Jets|AFC|EAST
BAL|Baltimore Ravens|AFC|NORTH
CIN|Cincinnati Bengals|AFC|NORTH
CLE|Cleveland Browns|AFC|NORTH
PIT|Pittsburgh Steelers|AFC|NORTH
HOU|Houston Texans|AFC|SOUTH
IND|Indianapolis Colts|AFC|SOUTH
JAX|Jacksonville Jaguars|AFC|SOUTH
TEN|Tennessee Titans|AFC|SOUTH
DEN|Denver Broncos|AFC|WEST
KC|Kansas City Chiefs|AFC|WEST
LV|Las Vegas Raiders|AFC|WEST
LAC|Los Angeles Chargers|AFC|WEST
DAL|Dallas Cowboys|NFC|EAST
NYG|New York Giants|NFC|EAST
PHI|Philadelphia Eagles|NFC|EAST
WAS|Washington Commanders|NFC|EAST
CHI|Chicago Bears|NFC|NORTH
DET|Detroit Lions|NFC|NORTH
GB|Green Bay Packers|NFC|NORTH
MIN|Minnesota Vikings|NFC|NORTH
ATL|Atlanta Falcons|NFC|SOUTH
CAR|Carolina Panthers|NFC|SOUTH
NO|New Orleans Saints|NFC|SOUTH
TB|Tampa Bay Buccaneers|NFC|SOUTH
ARI|Arizona Cardinals|NFC|WEST
LAR|Los Angeles Rams|NFC|WEST
SF|San Francisco 49ers|NFC|WEST
SEA|Seattle Seahawks|NFC|WEST
"""
#: Home stadium of each team: abbreviation, name, city, roof, surface, time zone, altitude in feet.
STADIUMS = """
BUF|Highmark Stadium|Orchard Park, NY|OUTDOOR|TURF|America/New_York|600
MIA|Hard Rock Stadium|Miami Gardens, FL|OUTDOOR|GRASS|America/New_York|10
NE|Gillette Stadium|Foxborough, MA|OUTDOOR|TURF|America/New_York|290
NYJ|MetLife Stadium|East Rutherford, NJ|OUTDOOR|TURF|America/New_York|10
BAL|M&T Bank Stadium|Baltimore, MD|OUTDOOR|GRASS|America/New_York|50
CIN|Paycor Stadium|Cincinnati, OH|OUTDOOR|TURF|America/New_York|490
CLE|Huntington Bank Field|Cleveland, OH|OUTDOOR|GRASS|America/New_York|580
PIT|Acrisure Stadium|Pittsburgh, PA|OUTDOOR|GRASS|America/New_York|730
HOU|NRG Stadium|Houston, TX|RETRACTABLE|TURF|America/Chicago|50
IND|Lucas Oil Stadium|Indianapolis, IN|RETRACTABLE|TURF|America/Indiana/Indianapolis|720
JAX|EverBank Stadium|Jacksonville, FL|OUTDOOR|GRASS|America/New_York|10
TEN|Nissan Stadium|Nashville, TN|OUTDOOR|TURF|America/Chicago|400
DEN|Empower Field at Mile High|Denver, CO|OUTDOOR|GRASS|America/Denver|5280
KC|GEHA Field at Arrowhead Stadium|Kansas City, MO|OUTDOOR|GRASS|America/Chicago|900
LV|Allegiant Stadium|Las Vegas, NV|DOME|GRASS|America/Los_Angeles|2000
LAC|SoFi Stadium|Inglewood, CA|DOME|TURF|America/Los_Angeles|100
DAL|AT&T Stadium|Arlington, TX|RETRACTABLE|TURF|America/Chicago|600
NYG|MetLife Stadium|East Rutherford, NJ|OUTDOOR|TURF|America/New_York|10
PHI|Lincoln Financial Field|Philadelphia, PA|OUTDOOR|GRASS|America/New_York|40
WAS|Northwest Stadium|Landover, MD|OUTDOOR|GRASS|America/New_York|200
CHI|Soldier Field|Chicago, IL|OUTDOOR|GRASS|America/Chicago|590
DET|Ford Field|Detroit, MI|DOME|TURF|America/Detroit|600
GB|Lambeau Field|Green Bay, WI|OUTDOOR|GRASS|America/Chicago|640
MIN|U.S. Bank Stadium|Minneapolis, MN|DOME|TURF|America/Chicago|830
ATL|Mercedes-Benz Stadium|Atlanta, GA|RETRACTABLE|TURF|America/New_York|1000
CAR|Bank of America Stadium|Charlotte, NC|OUTDOOR|TURF|America/New_York|750
NO|Caesars Superdome|New Orleans, LA|DOME|TURF|America/Chicago|10
TB|Raymond James Stadium|Tampa, FL|OUTDOOR|GRASS|America/New_York|30
ARI|State Farm Stadium|Glendale, AZ|RETRACTABLE|GRASS|America/Phoenix|1070
LAR|SoFi Stadium|Inglewood, CA|DOME|TURF|America/Los_Angeles|100
SF|Levi's Stadium|Santa Clara, CA|OUTDOOR|GRASS|America/Los_Angeles|20
SEA|Lumen Field|Seattle, WA|OUTDOOR|TURF|America/Los_Angeles|20
"""


def teams(spark: SparkSession) -> DataFrame:
    """team_id (0 to 31), abbreviation, name, conference, division."""
    rows = [(i, *line.split("|")) for i, line in enumerate(TEAMS.split("\n")[1:-1])]
    return spark.createDataFrame(rows, "team_id int, abbreviation string, name string, conference string, division string")


def stadiums(spark: SparkSession) -> DataFrame:
    """team_id (0 to 31) with its stadium, city, stadium_roof, surface, timezone and altitude."""
    rows = [(i, *line.split("|")[1:6], int(line.split("|")[6])) for i, line in enumerate(STADIUMS.split("\n")[1:-1])]
    return spark.createDataFrame(rows, "team_id int, stadium string, city string, stadium_roof string, surface string, timezone string, altitude int")
