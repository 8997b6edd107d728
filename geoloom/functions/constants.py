"""Constants that fix the meaning of coordinates and rasters."""

CIRCUMFERENCE_M = 40075017.0
TILE_PX = 256
MERCATOR_LAT = 85.05112878
COVER_LAT = (-60.0, 84.0)
CLIMATE_LAT = (-90.0, 90.0)
LAND_ZOOM, OCEAN_ZOOM = 15, 10
ELEVATION_RES_M, COVER_RES_M = 30.0, 10.0
MAX_STEP = 256
WATER_COVER, NO_COVER, SNOW_COVER, MANGROVE_COVER = 80, 0, 70, 95
#: Climate codes 1 to 30, in order.
CLIMATE_CODES = ("Af", "Am", "Aw", "BWh", "BWk", "BSh", "BSk", "Csa", "Csb", "Csc", "Cwa", "Cwb", "Cwc", "Cfa", "Cfb", "Cfc", "Dsa", "Dsb", "Dsc", "Dsd", "Dwa", "Dwb", "Dwc", "Dwd", "Dfa", "Dfb", "Dfc", "Dfd", "ET", "EF")
