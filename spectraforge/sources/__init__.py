"""Sources and sinks: flat dumps of spectra and mzML documents."""
