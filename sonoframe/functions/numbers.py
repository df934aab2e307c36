"""Number rules as column expressions: levels, frequencies, clocks, positions, views and rates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENT, QUIET = -200.0, -100.0


def amplitude_db(a: Column) -> Column:
    """Decibels of an amplitude, -100 at least."""
    return F.greatest(20 * F.log10(a), F.lit(QUIET))


def power_db(p: Column) -> Column:
    """Decibels of a power, -200 at least."""
    return F.greatest(10 * F.log10(p), F.lit(SILENT))


def gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def lifted(level: Column, gain_db: Column) -> Column:
    """A level with a gain, -100 at least; silence stays silent."""
    return F.when(level > QUIET, F.greatest(level + gain_db, F.lit(QUIET))).otherwise(F.lit(QUIET))


def meter_position(db: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (db + 60) / 60))


def hz_scale(semitones: Column) -> Column:
    return F.pow(F.lit(2.0), semitones / 12)


def frequency_place(hz: Column, lo: float, hi: float, logarithmic: bool) -> Column:
    """Where a frequency stands on an axis from lo to hi, 0 to 1."""
    if logarithmic:
        return F.ln(F.greatest(hz, F.lit(lo)) / lo) / math.log(hi / lo)
    return (hz - lo) / (hi - lo)


def frequency_at(place: Column, lo: float, hi: float, logarithmic: bool) -> Column:
    return lo * F.pow(F.lit(hi / lo), place) if logarithmic else lo + place * (hi - lo)


def _half_even(x: Column, n: int) -> Column:
    """A double rounded to n decimals: halves of the scaled double (x * 10^n, not x's shortest decimal form) go to even."""
    return F.rint(x * 10.0**n) / 10.0**n if n else F.rint(x)


def hz_text(hz: Column) -> Column:
    """`440`, `2.5k`, `192k`, `1.25M`: whole below 1 kHz, one decimal at most for k, two for M."""
    fixed = lambda x, n: _half_even(x, n).cast(f"decimal(18,{n})").cast("string")
    k = hz / 1e3
    mega = F.concat(F.regexp_replace(fixed(hz / 1e6, 2), r"\.?0+$", ""), F.lit("M"))
    whole = F.abs(k - F.round(k)) < 0.05
    return F.when(hz < 1e3, fixed(hz, 0)).when(hz >= 1e6, mega).when(whole, F.concat(fixed(k, 0), F.lit("k"))).otherwise(F.concat(fixed(k, 1), F.lit("k")))


def _decimals(x: Column, n: int) -> Column:
    return _half_even(x, n).cast(f"decimal(20,{n})").cast("string")


def hz_field(hz: Column) -> Column:
    """As a slider shows it: `440 Hz`, `2.50 kHz`, `12.0 kHz`, and megahertz with three decimals at most."""
    mega = F.regexp_replace(_decimals(hz / 1e6, 3), r"\.?0+$", "")
    return F.when(hz >= 1e6, F.concat(mega, F.lit(" MHz"))).when(hz >= 1e4, F.concat(_decimals(hz / 1e3, 1), F.lit(" kHz"))).when(hz >= 1e3, F.concat(_decimals(hz / 1e3, 2), F.lit(" kHz"))).otherwise(F.concat(_decimals(hz, 0), F.lit(" Hz")))


def hz_exact(hz: Column) -> Column:
    """To the resolution of a spectrum's bins: `440.0 Hz`, `2.500 kHz`, `12.00 kHz`."""
    return F.when(hz >= 1e4, F.concat(_decimals(hz / 1e3, 2), F.lit(" kHz"))).when(hz >= 1e3, F.concat(_decimals(hz / 1e3, 3), F.lit(" kHz"))).otherwise(F.concat(_decimals(hz, 1), F.lit(" Hz")))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _fraction(ticks: Column, decimals: int) -> Column:
    return F.concat(F.lit("."), F.lpad((ticks % 10**decimals).cast("string"), decimals, "0")) if decimals else F.lit("")


def clock(seconds: Column, decimals: int = 0) -> Column:
    """`m:ss`, or `h:mm:ss` from an hour on, rounded to so many decimals of a second; no time is under 0."""
    ticks = F.round(F.greatest(seconds, F.lit(0.0)) * 10**decimals).cast("long")
    whole = F.floor(ticks / 10**decimals)
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    text = F.when(h > 0, F.concat_ws(":", h.cast("string"), _two(m), _two(s))).otherwise(F.concat_ws(":", m.cast("string"), _two(s)))
    return F.when(seconds.isNotNull(), F.concat(text, _fraction(ticks, decimals)))


def wall(seconds: Column, decimals: int = 0) -> Column:
    """The time of day, `hh:mm:ss`, of seconds since a midnight, rounded; what rounds up to midnight is 00:00:00."""
    ticks = F.round(F.pmod(seconds.cast("double"), F.lit(86400.0)) * 10**decimals).cast("long") % (86400 * 10**decimals)
    whole = F.floor(ticks / 10**decimals)
    return F.concat(F.concat_ws(":", _two(F.floor(whole / 3600)), _two(F.floor(whole / 60) % 60), _two(whole % 60)), _fraction(ticks, decimals))


def sample_time(samples: Column, rate: Column) -> Column:
    """The time of day, `hh:mm:ss.sss`, of a count of samples since midnight, milliseconds cut off; past midnight it begins again."""
    ms = F.floor(samples * 1000 / rate) % 86_400_000
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(F.concat_ws(":", pad(F.floor(ms / 3600000), 2), pad(F.floor(ms / 60000) % 60, 2), pad(F.floor(ms / 1000) % 60, 2)), F.lit("."), pad(ms % 1000, 3))


def time_samples(text: Column, rate: Column) -> tuple[Column, Column]:
    """Samples since midnight of `hh:mm:ss`, with or without a fraction, 0 for none; and what is wrong with another text."""
    p = r"(?U)^\s*\+?([0-9]+):\+?([0-9]+):(\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+))\s*\z"
    h, m, s = (F.regexp_extract(text, p, i).try_cast("double") for i in (1, 2, 3))
    none = text.rlike(r"(?U)^\s*\z")
    good = text.rlike(p) & (h < 24) & (m < 60) & (s < 60)
    samples = F.when(none, F.lit(0).cast("long")).when(good, F.round((h * 3600 + m * 60) * rate + s * rate).cast("long"))
    wrong = F.concat(F.lit("Start "), F.regexp_replace(text, r"(?U)^\s+|\s+\z", ""), F.lit(" is not a time of day like 13:45:10.250"))
    return samples, F.when(text.isNotNull() & samples.isNull(), wrong)


def nearest_preset(speed: Column, slow: bool) -> Column:
    """The preset nearest a speed by their logarithms, among those on offer; of equals the slower."""
    presets = F.array(*map(F.lit, (*(SLOW_SPEEDS if slow else ()), *FAST_SPEEDS)))
    return F.array_min(F.transform(presets, lambda x: F.struct(F.abs(F.ln(x) - F.ln(speed)).alias("off"), x.alias("speed"))))["speed"]


def clock_seconds(text: Column) -> Column:
    """Seconds since midnight of `hh:mm:ss`, also with - or . between; more parts don't matter. Null for anything else."""
    part = lambda i: F.regexp_extract(F.trim(F.get(F.split(text, "[:.-]"), F.lit(i))), r"^\+?([0-9]+)$", 1).try_cast("long")
    h, m, s = part(0), part(1), part(2)
    return F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def parse_speed(text: Column) -> Column:
    """`2`, `1/8`, `0.125x`, `×2` as a positive factor; null for anything else."""
    s = F.regexp_replace(F.trim(text), "^[xX×]+|[xX×]+$", "")
    parts = F.split(s, "/")
    number = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    value = F.when(F.size(parts) == 2, F.try_divide(number(0), number(1))).when(F.size(parts) == 1, number(0))
    return F.when((value > 0) & (value < float("inf")), value)


def speed_text(speed: Column) -> Column:
    """A speed as a label shows it: a whole number of times slower as a fraction, else four significant digits."""
    over = 1 / speed
    slower = (speed < 1) & (F.abs(over - F.round(over)) < 1e-6)
    places = F.greatest(3 - F.floor(F.log10(speed)), F.lit(0)).cast("int")
    shown = F.lit(None).cast("string")
    for n in range(12):
        shown = F.when(places == n, F.regexp_replace(_decimals(speed, n), r"\.0*$|(\.[0-9]*?)0+$", "$1") if n else _decimals(speed, 0)).otherwise(shown)
    return F.when(slower, F.concat(F.lit("1/"), F.round(over).cast("long").cast("string"), F.lit("×"))).otherwise(F.concat(shown, F.lit("×")))


def nanoseconds(frame: Column, rate: Column) -> Column:
    """The time of a frame in nanoseconds, rounded up, so that the frame can be found again by rounding down."""
    exact = frame.cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.ceil(exact / rate.cast("decimal(10,0)")).cast("long")


def rescaled(position: Column, rate: Column, to: Column) -> Column:
    """A position at another rate, rounded down, exact beyond 64 bits."""
    return F.floor(position.cast("decimal(20,0)") * to.cast("decimal(10,0)") / rate.cast("decimal(10,0)")).cast("long")


#: Sample rates that MP3 has.
MP3_RATES = (8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000)


def mp3_rate(rate: Column) -> Column:
    """The least rate of MP3 that isn't under a rate; beyond its highest, the one of 44.1 and 48 kHz of whose family a rate is."""
    least = F.array_min(F.filter(F.array(*map(F.lit, MP3_RATES)), lambda r: r >= rate))
    return F.when((rate > MP3_RATES[-1]) & (rate % 11025 == 0), F.lit(44100)).otherwise(F.coalesce(least, F.lit(MP3_RATES[-1])))


def vorbis_rate(rate: Column) -> Column:
    """A rate, halved until it is 200 kHz or less."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(16)), rate.cast("long"), lambda r, _: F.when(r > 200000, F.floor(r / 2)).otherwise(r))


def khz_text(rate: Column) -> Column:
    return F.concat(F.regexp_replace((rate.cast("decimal(12,0)") / 1000).cast("decimal(12,3)").cast("string"), r"\.?0+$", ""), F.lit(" kHz"))


def nice_step(span: Column, most: Column) -> Column:
    """The least step of 1, 2, 2.5 or 5 times a power of ten that makes at most `most` steps of a span."""
    raw = span / most
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    lead = raw / power
    near = lambda x: lead <= x * (1 + 1e-9)
    return power * F.when(near(1.0), 1.0).when(near(2.0), 2.0).when(near(2.5), 2.5).when(near(5.0), 5.0).otherwise(10.0)


def animal_change(hz: Column) -> Column:
    """How far a voice is beyond hearing: above 20 kHz by fifths of a log scale, below 20 Hz by octaves; 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(hz > 20000, F.ln(hz / 20000) / math.log(5)).when(hz < 20, F.log2(20 / hz)).otherwise(0.0)))


def nearest_bin(hz: Column, bin_hz: Column, bins: int) -> Column:
    """The bin of a frequency; null past the last one's own, which is all that the file holds."""
    return F.when(hz <= bin_hz * (bins - 1), F.least(F.round(hz / bin_hz), F.lit(bins - 1.0)).cast("long"))


def packed(seek: Column, frame: Column) -> Column:
    """A seek number in the high 16 bits and a frame in the low 48; the upper half of the seeks gives negative numbers."""
    return F.shiftleft(F.pmod(seek.cast("long"), F.lit(65536)), 48).bitwiseOR(frame.bitwiseAND(F.lit((1 << 48) - 1)))


def unpacked(position: Column) -> tuple[Column, Column]:
    """The seek number and the frame of a packed position."""
    return F.shiftrightunsigned(position, 48), position.bitwiseAND(F.lit((1 << 48) - 1))


def view(start: Column, length: Column, frames: Column, rate: int) -> tuple[Column, Column]:
    """A view clamped to a file: at least a millisecond or 64 frames long, never past the end."""
    length = F.least(F.greatest(length, F.lit(max(rate // 1000, 64)).cast("long")), frames)
    return F.greatest(F.lit(0).cast("long"), F.least(start, frames - length)), length


def zoomed(start: Column, length: Column, anchor: Column, factor: Column, frames: Column, rate: int) -> tuple[Column, Column]:
    """A view zoomed by a factor, with the anchor staying where it is on screen, within the file."""
    new = length * factor
    return view(anchor - (anchor - start) / length * new, new, frames, rate)


def paged(start: Column, length: Column, playhead: Column, frames: Column, rate: int) -> Column:
    """A view's start as the playhead moves: past nine tenths, unless the view ends where the file does, or before the start, it moves back to one tenth."""
    past = (playhead > start + 0.9 * length) & (start + length < frames)
    return F.when(past | (playhead < start), view(playhead - 0.1 * length, length, frames, rate)[0]).otherwise(start)


#: The highest frequency that a band is set to.
HIGHEST_HZ = 1_000_000.0


def band(lo: Column, hi: Column, rate: Column, fft: int, logarithmic: bool) -> tuple[Column, Column]:
    """The band drawn of one asked for: two bins up at least and at most a megahertz, or what the file holds; never down to 0 on a log axis."""
    nyquist, one = rate / 2, rate / fft
    top = F.greatest(F.least(hi, F.greatest(F.lit(HIGHEST_HZ), nyquist)), one * 2)
    return F.least(F.greatest(lo, one if logarithmic else F.lit(0.0)), top - one), top


def held_band(lo: Column, hi: Column, rate: Column, fft: int, logarithmic: bool) -> tuple[Column, Column]:
    """The part of a band that the file holds, up to half its rate; nulls where the band starts above that."""
    low, high = band(lo, hi, rate, fft, logarithmic)
    some = low < rate / 2
    return F.when(some, low), F.when(some, F.least(high, rate / 2))


#: For each setting the least and most it may be, and what it is without a number; transform sizes and speeds to choose from.
BOUNDS = {"brightness": (-20.0, 80.0, 0.0), "contrast": (20.0, 160.0, 90.0), "gain": (-60.0, 60.0, 0.0), "pitch": (-48.0, 48.0, 0.0), "band_low": (0.0, HIGHEST_HZ, 0.0), "area_width": (1.0, 8.0, 3.0), "area_fill": (0.0, 0.6, 0.18)}
FFT_SIZES, USUAL_FFT = (512, 1024, 2048, 4096, 8192), 2048
SLOW_SPEEDS, FAST_SPEEDS = (0.1, 0.125, 0.25, 0.5), (1.0, 2.0, 4.0, 8.0)


def setting(name: str, value: Column) -> Column:
    """A setting within its bounds; what isn't a finite number is its usual value. Pitches are whole."""
    least, most, usual = BOUNDS[name]
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    kept = F.when(finite, F.greatest(F.lit(least), F.least(F.lit(most), value))).otherwise(usual)
    return F.round(kept) if name == "pitch" else kept


def fft_setting(size: Column) -> Column:
    return F.when(size.isin(*FFT_SIZES), size).otherwise(USUAL_FFT)


def speed_setting(speed: Column, slow: bool) -> Column:
    """The preset that a speed is; slow ones only where they are on offer, else normal."""
    presets = (*(SLOW_SPEEDS if slow else ()), *FAST_SPEEDS)
    return F.coalesce(*[F.when(F.abs(speed - x) < 1e-9, F.lit(x)) for x in presets], F.lit(1.0))


def band_high_setting(hz: Column) -> Column:
    """The upper end of a band, at most a megahertz; null for none."""
    return F.when((hz > 0) & (hz < float("inf")), F.least(hz, F.lit(HIGHEST_HZ)))


def size_text(size: Column) -> Column:
    """Megabytes with one decimal under 100, none from there on; halves go to even."""
    mb = size.cast("decimal(20,0)") / 1_000_000
    return F.when(size >= 100_000_000, F.concat(F.bround(mb, 0).cast("decimal(20,0)").cast("string"), F.lit(" MB"))).otherwise(F.concat(F.bround(mb, 1).cast("decimal(20,1)").cast("string"), F.lit(" MB")))


def level_text(db: Column) -> Column:
    """A level to one decimal; minus infinity at the floor and under it."""
    return F.when(db <= QUIET, "-∞").otherwise(F.format_string("%.1f", db))


#: The seconds that ticks of a time axis may be apart.
TIME_STEPS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 30.0, 60.0, 120.0, 300.0, 600.0, 900.0, 1800.0, 3600.0, 7200.0, 14400.0)
LONGEST_STEP = 28800.0


def time_step(seconds: Column, width: Column) -> Column:
    """The least step that leaves each of an axis's labels 90 points of its width."""
    fits = F.greatest(width / 90, F.lit(1.0))
    return F.when(seconds.isNotNull() & width.isNotNull(), F.coalesce(*[F.when(seconds / s <= fits, s) for s in TIME_STEPS], F.lit(LONGEST_STEP)))


def step_decimals(step: Column) -> Column:
    """How many decimals tell ticks of a step apart."""
    return F.when(step >= 1.0, 0).when(step >= 0.1, 1).when(step >= 0.01, 2).when(step.isNotNull(), 3)


def linear_ticks(lo: Column, hi: Column, length: Column) -> Column:
    """The frequencies of an axis's ticks, at least 55 points apart where it has room for two; none if hi is under lo."""
    step = nice_step(hi - lo, F.greatest(length / 55, F.lit(2.0)))
    first, last = F.ceil(lo / step), F.floor(hi / step)
    return F.when(hi > lo, F.transform(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")), lambda i: i * step)).otherwise(F.array().cast("array<double>"))


def log_ticks(lo: Column, hi: Column, length: Column, room: Column) -> Column:
    """1, 2 and 5 of each decade from lo to hi, or the decades alone where so many labels have no room; null unless 0 < lo <= hi."""
    decades = F.sequence(F.floor(F.log10(lo)), F.floor(F.log10(hi)))
    at = lambda *leads: F.filter(F.flatten(F.transform(decades, lambda d: F.array(*[F.pow(F.lit(10.0), d) * x for x in leads]))), lambda f: (f >= lo) & (f <= hi))
    return F.when((lo > 0) & (hi >= lo), F.when(F.size(at(1.0, 2.0, 5.0)) * room > length, at(1.0)).otherwise(at(1.0, 2.0, 5.0)))


def export_stem(stem: Column, first: Column, last: Column, rate: Column) -> Column:
    """The name of a picture of a stretch of frames, without its extension."""
    return F.concat(stem, F.lit(" "), F.format_string("%.2f", first / rate), F.lit("-"), F.format_string("%.2f", last / rate), F.lit(" s"))
