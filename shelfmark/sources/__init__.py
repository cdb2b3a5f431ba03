"""Readers and writers of the file formats that a catalogue lives on."""
