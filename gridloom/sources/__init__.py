"""Sources and sinks: classic array files, their text form, validation and layout reports."""
