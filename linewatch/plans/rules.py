"""Limit sets of the monitored stations, as rule rows.

Each set is one report's limits; the hourly and shift-summary sets differ where
the original limits differ. Rows are ``(parameter_name, work_location_id, low, high)``;
a NULL location means the rule holds at every location, and a rule that holds
at two locations is two rows.
"""

from __future__ import annotations

# Vision-check limits of the pin station, hourly report (17 rules, on the raw value).
VISION_LIMITS = [
    ("Value Height Pin X", None, 40, 46.3),
    ("Value Pixle Area Pin X", None, 2600, 7500),
    ("Value Blob X Feret Diameters Pin X", None, 1.8, 3.6),
    ("Value Blob Y Feret Diameters Pin X", None, 0.8, 2.2),
    ("Value Angle 1 Pin X", None, 13, 45),
    ("Value Angle 2 Pin X", None, -45, 13),
    ("Value Level Difference", None, 0, 0.7),
    ("Value Angle Connection Phase 1", None, -2.5, 2.5),
    ("Value Angle Connection Phase 2", None, -2.5, 2.5),
    ("Value Angle Connection Phase 3", None, -2.5, 2.5),
    ("Value Height Connection Phase 1", None, 11.35, 12.90),
    ("Value Height Connection Phase 2", None, 11.35, 12.90),
    ("Value Height Connection Phase 3", None, 11.35, 12.90),
    ("Value X Connection Element 1", None, -5.10, -3.9),
    ("Value X Connection Element 2", None, -6.30, -5.6),
    ("Value Y Connection Element 1", None, -23.85, -22.95),
    ("Value Y Connection Element 2", None, -94.95, -94.05),
]

# The same station in the shift summary; the connection heights use -2.5 .. 2.5.
VISION_LIMITS_SHIFT = [
    ("Value Height Pin X", None, 40, 46.3),
    ("Value Pixle Area Pin X", None, 2600, 7500),
    ("Value Blob X Feret Diameters Pin X", None, 1.8, 3.6),
    ("Value Blob Y Feret Diameters Pin X", None, 0.8, 2.2),
    ("Value Angle 1 Pin X", None, 13, 45),
    ("Value Angle 2 Pin X", None, -45, 13),
    ("Value Level Difference", None, 0, 0.7),
    ("Value Angle Connection Phase 1", None, -2.5, 2.5),
    ("Value Angle Connection Phase 2", None, -2.5, 2.5),
    ("Value Angle Connection Phase 3", None, -2.5, 2.5),
    ("Value Height Connection Phase 1", None, -2.5, 2.5),
    ("Value Height Connection Phase 2", None, -2.5, 2.5),
    ("Value Height Connection Phase 3", None, -2.5, 2.5),
    ("Value X Connection Element 1", None, -5.1, -3.9),
    ("Value Y Connection Element 1", None, -23.85, -22.95),
    ("Value X Connection Element 2", None, -6.3, -5.6),
    ("Value Y Connection Element 2", None, -94.95, -94.05),
]

# Pin limits used to pick failing units for the origin trace (9 rules).
# The summary copy of the "Angle 2" rule reads "< -45 or > -45"; the hourly rule below is used for both.
PIN_TRACE_LIMITS = [
    ("Value Height Pin X", None, 39, 47),
    ("Value Pixle Area Pin X", None, 5000, 12000),
    ("Value Blob X Feret Diameters Pin X", None, 2.6, 3.9),
    ("Value Blob Y Feret Diameters Pin X", None, 1.2, 3.0),
    ("Value Angle 1 Pin X", None, -45, 45),
    ("Value Angle 2 Pin X", None, -45, 45),
    ("Value Level Difference", None, 0, 0.6),
    ("Value Pin 1 edge to stack edge", None, 0, 100000),
    ("Value Pin 5 edge to stack edge", None, 0, 100000),
]

# Electrical end-of-line test limits by work location (18 rules, 19 rows).
ELECTRICAL_LIMITS = [
    ("AmbientTemperature Value", 1, 0, 50),
    ("AmbientTemperature Value", 2, 0, 50),
    ("Area Waveform UV Value", 2, -3, 3),
    ("Area Waveform VW Value", 2, -3, 3),
    ("Area Waveform WU Value", 2, -3, 3),
    ("Humidity Value", 2, 0, 100),
    ("InbalanceOfAllPhasesU Value", 1, 0, 1.5),
    ("Insulation Resistance UVW to GND Value", 1, 200, 10000),
    ("Insulation Voltage UVW to GND Value", 1, 450, 550),
    ("PartTemperature Value", 1, 0, 100),
    ("Pdiv HvAc Value", 1, 800, 10000),
    ("Pdiv UV Value", 2, 1400, 10000),
    ("Pdiv VW Value", 2, 1400, 10000),
    ("Pdiv WU Value", 2, 1400, 10000),
    ("PhaseResistance between UV Value", 1, 10.637, 11.523),
    ("PhaseResistance between VW Value", 1, 10.637, 11.523),
    ("PhaseResistance between WU Value", 1, 10.637, 11.523),
    ("Withstand Current UVW to GND Value", 1, 0, 15),
    ("Withstand Voltage UVW to GND Value", 2, 1850, 1950),
]
