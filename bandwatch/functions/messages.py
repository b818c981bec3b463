"""Alarm keys and message texts."""

from pyspark.sql import Column, functions as F

# The message formats, identical to those operators of the system know.
SINGLE_FORMAT = {
    "pid": "Pid alarm for %s measurement %s%s: %.3f is outside alarm range (%.3f, %.3f)",
    "simple": "Simple alarm for %s measurement %s%s: %.3f is outside alarm range (%.3f, %.3f)",
    "timesince": "TimeSince alarm for %s measurement %s%s: %.3f is outside alarm range "
                 "(%.3f, %.3f) for more than %.0f seconds",
}
GROUP_HEADING = {
    "and": "Following alarms are all active: \n",
    "or": "At least one of the following alarms is active: \n",
}
MEMBER_WITH_HOST = "%s alarm of %s of %s \n "
MEMBER = "%s alarm of %s \n"


def alarm_key(host: Column, reading_name: Column, alarm_type: Column) -> Column:
    """`[host,]reading,type`: how alarm groups name their members."""
    return F.concat_ws(",", F.nullif(host, F.lit("")), reading_name, alarm_type)


def single_text(
    alarm_type: Column, channel: Column, reading_name: Column, host: Column, params: Column
) -> Column:
    """Message of one alarm that belongs to no group; '' for a type without a text."""
    of_host = F.when(host != "", F.concat(F.lit(" of "), host)).otherwise("")
    text = F.lit("")
    for kind, fmt in SINGLE_FORMAT.items():
        args = [F.get(params, F.lit(i)) for i in range(fmt.count("%."))]
        text = F.when(
            alarm_type == kind, F.format_string(fmt, channel, reading_name, of_host, *args)
        ).otherwise(text)
    return text


def group_text(operation: Column, names: Column) -> Column:
    """Message of a satisfied group: heading by operation, then one line per listed name."""

    def line(name: Column) -> Column:
        part = F.split(name, ",")
        return F.when(
            F.size(part) == 3,
            F.format_string(MEMBER_WITH_HOST, *(F.get(part, F.lit(i)) for i in (2, 1, 0))),
        ).otherwise(F.format_string(MEMBER, F.get(part, F.lit(1)), F.get(part, F.lit(0))))

    heading = F.when(operation == "and", GROUP_HEADING["and"]).otherwise(GROUP_HEADING["or"])
    return F.concat(heading, F.array_join(F.transform(names, line), ""))
